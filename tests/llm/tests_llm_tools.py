"""Brute-force versions shared by the tests."""


def brute_lines(docs, least):
    """All runs of lines, not only shortest ones."""
    first, runs = {}, []
    for d, t in docs:
        lines = t.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(map(len, run)) + len(run) >= least:
                    first[run] = min(first.get(run, (d, i)), (d, i))
                    runs.append((d, i, j, run))
    gone = {d: set() for d, _ in docs}
    for d, i, j, run in runs:
        if (d, i) > first[run]:
            gone[d].update(range(i, j))
    return {d: [x for k, x in enumerate(t.split("\n")) if k not in gone[d]] for d, t in docs}
