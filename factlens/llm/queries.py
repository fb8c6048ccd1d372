"""Queries of this subpackage over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import (
    bpe, chat, decontam, langid, license_scan, line_dedup, mixing, multiset, periodic, secret_scan, simhash, suffix_dedup,
    trie)
from factlens.llm.common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.compare_edited(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("own.fingerprint").alias("fingerprint"),
                        F.col("edited_digest.fingerprint").alias("edited_fingerprint"),
                        multiset.likeness("own", "edited_digest").alias("near_edited"),
                        multiset.likeness("own", "next_digest").alias("near_next"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontam.contamination(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.held_out("doc_id")
    model = langid.train(docs.filter(~held), "text", "lang", F.col("doc_id"))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    done = chat.format_conversations(chat.threads(rows.unionByName(more)))
    said = done.select(F.col("tree").alias("conv_id"), chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    line = F.transform("licenses", lambda x: F.concat_ws(
        ":", x["license"], x["matched"].cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
                        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"),
                        F.array_join(line, ",").alias("licenses"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    done = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    return done.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each document whose id's crc32 is divisible by 10 and
    that has words, the words from a on become a repeated piece of its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n = F.regexp_extract_all("text", F.lit(f"({periodic.WORD})"), F.lit(1)), F.size("_w")
    cut = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    g = F.floor(F.col("_h") / 10)
    a = F.when(n > 0, g % n).cast("int")
    cut = cut.withColumn("_n", n).withColumn("_a", a).withColumn("_p", (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int"))
    tail = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    often = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    rebuilt = F.concat(F.slice("_w", F.lit(1), F.col("_a")),
                       F.slice(F.flatten(F.array_repeat(tail, often)), F.lit(1), F.col("_n") - F.col("_a")))
    return cut.select("doc_id", F.when(F.col("_n") > 0, F.array_join(rebuilt, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_period(documents(spark, sf_dir)))
    best = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.sign(b["length"] - a["length"]))
                        .when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(a["period"] - b["period"])).cast("int"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    first = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.get(best, F.lit(0)).alias("best"),
                         F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return first.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said, convs = trie.graft(trie.turns(rows))
    return trie.prefix_trie(said, convs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_dedup, op2_multiset_hash, op3_secret_scan, op4_simhash_dedup, op5_decontamination, op6_language_id,
        op7_line_dedup, op8_chat_format, op9_license_scan, op10_byte_bpe, op11_periodic_runs, op12_source_mix, op13_prefix_trie)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op5_decontamination"] = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + {decontam.WINDOW} - 1), ' ') AS t,
               least(len(w), {decontam.WINDOW}) AS m
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {decontam.WINDOW} + 1))) AS i
              FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
place AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, sizes WHERE len(w) >= m),
hit AS (SELECT p.doc_id, p.i, p.m, win.item FROM place p
        JOIN win ON win.m = p.m AND win.t = array_to_string(list_slice(p.w, p.i, p.i + p.m - 1), ' ')),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_LINE_WORD = rf"[{_CJK}]|[^ \t-\r{_CJK}\x{{3000}}-\x{{303F}}\x{{FF01}}\x{{FF0C}}\x{{FF0E}}\x{{FF1A}}\x{{FF1B}}\x{{FF1F}}]+"


def _shortest(kind: str, end: str, size: str, least: int) -> str:
    """The shortest runs from each line and up to each line that reach ``least``."""
    reach = f"b.pos >= a.pos AND b.{end} >= a.{end} - a.{size} + {least}"
    return f"""forward_{kind} AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS t FROM line a JOIN line b ON a.doc_id = b.doc_id AND {reach} GROUP BY 1, 2),
backward_{kind} AS (SELECT b.doc_id, max(a.pos) AS s, b.pos AS t FROM line a JOIN line b ON a.doc_id = b.doc_id AND {reach} GROUP BY 1, 3)"""


SQL["op7_line_dedup"] = f"""
WITH line AS (SELECT doc_id, pos, l, size, words, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS e,
                     sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS we
     FROM (SELECT *, length(l) + 1 AS size, len(regexp_extract_all(l, '{_LINE_WORD}')) AS words FROM
           (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
            FROM documents WHERE text IS NOT NULL))),
{_shortest("chars", "e", "size", line_dedup.MIN_CHARS)},
{_shortest("words", "we", "words", line_dedup.MIN_WORDS)},
run AS (SELECT * FROM forward_chars UNION SELECT * FROM backward_chars UNION SELECT * FROM forward_words UNION SELECT * FROM backward_words),
body AS (SELECT r.doc_id, r.s, r.t, string_agg(l.l, chr(10) ORDER BY l.pos) AS body
         FROM run r JOIN line l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.s AND r.t GROUP BY 1, 2, 3),
first AS (SELECT body, t - s AS m, min((doc_id, s)) AS f FROM body GROUP BY 1, 2 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, t)) AS pos
         FROM body JOIN first ON first.body = body.body AND first.m = t - s AND (doc_id, s) > first.f),
kept AS (SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.pos) AS t, count(*) AS n
         FROM line l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
       coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(kept.n, 0) AS n_removed, sha256(kept.t) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


_E, _W = multiset.EQUAL_LANES, multiset.WORDS
_MD5_WORD = ["('0x' || substr(md5(t), 1, 16))::UBIGINT", "('0x' || substr(md5(t), 17, 16))::UBIGINT"]


def _likeness_sql(a: str, b: str) -> str:
    def dot(x, y):
        return f"list_sum(list_transform(list_zip({x}.signs, {y}.signs), lambda z: z[1] * z[2]))::DOUBLE"
    size = f"sqrt({dot(a, a)} * {dot(b, b)})"
    return (f"CASE WHEN {a}.fingerprint = {b}.fingerprint THEN 1.0::DOUBLE WHEN {size} > 0 THEN "
            f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {dot(a, b)} / {size})) ELSE 0.0::DOUBLE END")


SQL["op2_multiset_hash"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, text, n, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first(doc_id) OVER (ORDER BY doc_id)) AS next,
      left(text, n - n // 4) || left(coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)), n // 4) AS edited FROM d),
t AS (SELECT doc_id, false AS is_edited, text FROM e UNION ALL SELECT doc_id, true, edited FROM e),
p AS (SELECT doc_id, is_edited, {', '.join(f"sum(('0x' || substr(sha256(t), {8 * k + 1}, 8))::UBIGINT)::HUGEINT % 4294967296 AS e{k}" for k in range(_E))}
      FROM (SELECT doc_id, is_edited, unnest(string_split(text, chr(10))) AS t FROM t) GROUP BY 1, 2),
c AS (SELECT doc_id, is_edited, count(*) AS n,
      {', '.join(f"sum(({_MD5_WORD[k // 16]} >> {k % 16}) & {multiset._PICK}::UBIGINT)::HUGEINT AS w{k}" for k in range(_W))}
      FROM (SELECT doc_id, is_edited, trim(unnest(regexp_split_to_array(text, '[.,\n]'))) AS t FROM t) WHERE t <> '' GROUP BY 1, 2),
v AS (SELECT p.*, coalesce(c.n, 0) AS n, {', '.join(f'coalesce(w{k}, 0) AS w{k}' for k in range(_W))}
      FROM p LEFT JOIN c USING (doc_id, is_edited)),
f AS (SELECT doc_id, is_edited,
      {' || '.join([f"lower(lpad(to_hex(e{k}::UBIGINT), 8, '0'))" for k in range(_E)] + [f"lower(lpad(to_hex(w{k}::UBIGINT), 16, '0'))" for k in range(_W)] + ["lower(lpad(to_hex(n::UBIGINT), 8, '0'))"])} AS fingerprint,
      list_transform(flatten([{', '.join('[' + ', '.join(f'(w{k}::UBIGINT >> {16 * j}) & 65535' for j in range(4)) + ']' for k in range(_W))}]), lambda x: 2 * x::BIGINT - n) AS signs FROM v)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint,
       {_likeness_sql('a', 'b')} AS near_edited, {_likeness_sql('a', 'x')} AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND NOT a.is_edited JOIN f b ON b.doc_id = e.doc_id AND b.is_edited
JOIN f x ON x.doc_id = e.next AND NOT x.is_edited
"""


def _escaped_length(x: str) -> str:
    marks = ["chr(92)", *("'" + c + "'" for c in chat.CONTROL)]
    return f"length({x}) + " + " + ".join(f"(length({x}) - length(replace({x}, {c}, ''))) // length({c})" for c in marks)


SQL["op8_chat_format"] = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
      sum({_escaped_length('role')} + {_escaped_length('text')} + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
      FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM g
"""


_BLANK_WORD = r"[^\x20\x09-\x0D]+"
_N_WORDS = f"len(regexp_extract_all(coalesce(text, ''), '{_BLANK_WORD}'))::BIGINT"

SQL["op12_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, {_N_WORDS} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
closed AS (SELECT *, coalesce(sum(source_size) OVER o, 0)::DOUBLE AS words, coalesce(sum(weight) OVER o, 0) AS gone FROM w
           WINDOW o AS (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE - 2.0::DOUBLE * words) / ((SELECT sum(weight) FROM w) - gone)) AS l FROM closed),
t AS (SELECT n, source, source_size, least(2.0::DOUBLE * source_size, weight * l) AS target FROM w, level),
copy AS (SELECT d.doc_id, d.size, t.n, t.source_size, t.target, e.epoch,
                ('0x' || substr(md5('{mixing.SEED}|' || e.epoch || '|' || d.doc_id), 1, 15))::BIGINT AS draw
         FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN (SELECT unnest([0, 1]) AS epoch) e
         ON e.epoch = 0 OR t.target > t.source_size),
served AS (SELECT *, sum(size) OVER (PARTITION BY n ORDER BY epoch, draw, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM copy),
part AS (SELECT *, least(size, greatest(floor(target)::BIGINT - start, 0)) AS head FROM served),
packet AS (SELECT doc_id, size, n, source_size, target, epoch, draw, start + head AS done, head AS words FROM part WHERE head > 0 OR size = 0
           UNION ALL SELECT doc_id, size, n, source_size, target, epoch, draw, start + size, size - head FROM part WHERE head < size),
placed AS (SELECT *, sum(words) OVER (ORDER BY CASE WHEN target > 0 THEN done / target ELSE 0 END, n, epoch, draw, doc_id ROWS UNBOUNDED PRECEDING) - words AS place FROM packet)
SELECT doc_id, size, source_size, target,
       sum(least(words, greatest(floor(1.5::DOUBLE * (SELECT sum(size) FROM d)) - place, 0)))::BIGINT AS taken
FROM placed GROUP BY doc_id, size, source_size, target
"""

SQL["op13_prefix_trie"] = f"""
WITH RECURSIVE raw AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT c, {_N_WORDS} AS w, length(role)::VARCHAR || ':' || role || text AS id,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS d FROM raw),
size AS (SELECT c, max(d) AS len FROM x GROUP BY 1),
digit AS (SELECT c, len, c::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS crc FROM size UNION ALL
          SELECT c, len, s, i + 1, {{step}} FROM digit WHERE i <= length(s)),
hashed AS (SELECT c, len, xor(crc, 4294967295::BIGINT) % 4 AS h FROM digit WHERE i > length(s)),
fit AS (SELECT a.c, a.h, a.c - (a.c % 20 + 20) % 20 AS base, least(a.h, coalesce(b.len, 0)) AS given
        FROM hashed a LEFT JOIN size b ON b.c = a.c - (a.c % 20 + 20) % 20),
told AS (SELECT f.c, x.d, x.w, x.id FROM fit f JOIN x ON x.c = f.base AND x.d <= f.given
         UNION ALL SELECT f.c, x.d - f.h + f.given, x.w, x.id FROM fit f JOIN x ON x.c = f.c AND x.d > f.h),
list AS (SELECT c, max(d) AS len, list(id ORDER BY d) AS ids, list(w ORDER BY d) AS ws FROM told GROUP BY 1),
every AS (SELECT fit.c, coalesce(len, 0) AS len, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM fit LEFT JOIN list USING (c)),
prefix AS (SELECT c, len, d, md5(list_slice(ids, 1, d)::VARCHAR) AS p, CASE WHEN d > 0 THEN md5(list_slice(ids, 1, d - 1)::VARCHAR) END AS up,
                  coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(generate_series(0, len)) AS d FROM every)),
node AS (SELECT d, p, any_value(up) AS up, any_value(w) AS w, min(c) AS c, count(*) AS n,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends FROM prefix GROUP BY 1, 2),
kid AS (SELECT d - 1 AS d, up AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kid USING (d, p)),
below AS (SELECT a.d, a.p, sum((y.n - 1) * y.w) AS saved, count(*) FILTER (y.kids = 0) AS leaves
          FROM full_node y JOIN prefix a ON a.c = y.c AND a.d <= y.d GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN below b USING (d, p) LEFT JOIN node u ON u.d = f.d - 1 AND u.p = f.up
"""
# one byte of crc32 (reflected polynomial, a fixed value), bit by bit
_step = "xor(crc, ascii(substr(s, i, 1))::BIGINT)"
for _ in range(8):
    _step = f"(SELECT CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END FROM (SELECT {_step} AS v))"
SQL["op13_prefix_trie"] = SQL["op13_prefix_trie"].replace("{step}", _step)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
