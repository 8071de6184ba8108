import re
from collections import defaultdict

from cumulus.llm.line_dedup import HALVES, LEADING, LONG_DOCS, MIN_DOCS, dedup_lines, keep_lines


def brute(rows):
    """[(kept text, lines, dropped)] in the order of the rows."""

    def keys(line):
        tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r\f\v]+", line) if t]
        n, lead, h = len(tokens), tuple(tokens[:LEADING]), len(tokens) // 2
        if not n:
            return []
        more = [("f", n, lead, tuple(tokens[:h])), ("s", n, lead, tuple(tokens[h:]))] if n >= HALVES else []
        return [("a", n, tuple(tokens)), *more]

    seen = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n") if text is not None else []:
            for k in keys(line):
                seen[k].add((key is not None, key or 0, text))
    first = {k: min(v, key=lambda x: x[:2])[:2] for k, v in seen.items() if len(v) >= (LONG_DOCS if k[0] == "a" and k[1] >= HALVES else MIN_DOCS)}
    out = []
    for key, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if all(k not in first or first[k] == (key is not None, key or 0) for k in keys(x))]
        out.append((key, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LONG = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"{LONG}\nmy own line\n\nuser 12 logged in"),
    (2, f"{LONG.replace('twelve', 'dozen')}\nuser 7 logged in\nanother own line"),
    (3, f"{LONG.replace('eleven', 'XI')}\nuser a9 logged in"),
    (4, "user  3\tlogged in\nuser 4 logged in"),
    (5, LONG.replace("one", "uno")),
    (6, None),
    (7, ""),
    (8, "\n\n"),
    (9, "w " * 50_000 + "\nmy own line"),
    (None, "user 5 logged in\nkept"),
    (10, "a passage of more than twelve words that only two documents have in common\nshort pair"),
    (11, "short pair\na passage of more than twelve words that only two documents have in common"),
]


def test_matches_brute_force(corpus):
    docs = corpus(ROWS)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__dropped"]
    got = sorted(((r["doc_id"], r["text"], r["__lines"], r["__dropped"]) for r in out.collect()), key=str)
    assert got == brute(ROWS)
    by = {r[0]: r[1] for r in got}
    assert by[None] == "user 5 logged in\nkept" and by[2] == "another own line" and by[4] == "" and by[5] == LONG.replace("one", "uno")
    assert by[11] == "short pair"
    assert dedup_lines(docs.limit(0)).count() == 0


def test_clashing_names_and_many_lines(corpus):
    names = ["__row", "__key", "__text", "__drops", "c0", "line", "template", "long"]
    docs = corpus([*ROWS, (12, "\n".join(["user 1 logged in", "x"] * 60_000))]).selectExpr("*", *[f"doc_id * 2 AS `{n}`" for n in names if n not in ("line", "template")])
    got = keep_lines(docs).collect()
    assert all(r["__row"] == r["__drops"] == r["c0"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in got)
    assert [r["text"] for r in got if r["doc_id"] == 12] == ["\n".join(["x"] * 60_000)]


def test_keep_lines(spark, corpus):
    docs = corpus([*ROWS, ROWS[0]]).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    out = keep_lines(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["None", "1", "1", "2", "5", "6", "7", "8", "9", "10", "11"])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
