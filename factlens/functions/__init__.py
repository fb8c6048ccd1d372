"""Column-level building blocks (all JVM-side, codegen friendly)."""
from factlens.functions.hashing import h32, unit_draw, draw_index
from factlens.functions.text import token_count, words, fill_template, WS_CLASS
from factlens.functions.metrics import precision_at, reciprocal_rank, target_likelihood, METRIC_KS

__all__ = ["h32", "unit_draw", "draw_index", "token_count", "words", "fill_template",
           "WS_CLASS", "precision_at", "reciprocal_rank", "target_likelihood", "METRIC_KS"]
