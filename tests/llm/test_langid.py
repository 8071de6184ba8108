import zlib

from cumulus.llm import langid
from cumulus.llm.langid import Parser, fit, identify, keep_identified, plain

SF = "/root/testdata/sf0.01"


def phrases(text: bytes, reference: bytes) -> int:
    """The greedy parse by substring search."""
    n = 0
    for at in range(0, len(text), langid.PIECE):
        piece, i = text[at : at + langid.PIECE], 0
        while i < len(piece):
            size = 0
            while i + size < len(piece) and piece[i : i + size + 1] in reference:
                size += 1
            n, i = n + 1, i + max(size, 1)
    return n


def test_parse_matches_search(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    samples = {str(k): plain(docs[k])[:1_500] for k in range(5)}
    parser = Parser(samples)
    bodies = [plain(t)[:3_000] for t in docs[5:]] + [b"", b"q", b"zz \xe4\xb8\xad"]
    for body in bodies:
        pieces = [body[i : i + langid.PIECE] for i in range(0, len(body), langid.PIECE)]
        got = parser.phrases(pieces).sum(axis=1) if pieces else [0] * 5
        want = [phrases(body, samples[s]) for s in parser.languages]
        assert list(got) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = docs.select("doc_id", "lang").collect()
    truth = {r["doc_id"]: r["lang"] for r in rows if fold(r["doc_id"]) == 2}
    from cumulus.llm.common import fold as column

    got = identify(docs, fit(docs.filter(column("doc_id", 4) != 2))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(corpus):
    a, b = "the cat and the dog sat on the mat " * 40, "der hund und die katze auf der matte " * 40
    rows = [(0, a, "en", "s"), (1, b, "de", "s"), (2, None, "en", "s"), (3, "", "de", "s"), (4, "123 !? \n", "en", "s"), (5, a, None, "s"), (None, b, "de", None), (0, a, "en", "s"), (6, "中文", "en", "s"), (7, b * 300, "de", "s")]
    docs = corpus(rows)
    parser = fit(docs)
    assert parser.languages == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, parser).collect()}
    assert got[0] == got[5] == "en" and got[1] == got[None] == got[7] == "de" and got[2] == got[3] == got[4] == "und"
    kept = keep_identified(docs, parser)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "0", "1", "5", "6", "7", "None"]
    none = fit(docs.limit(0))
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {"und"} and identify(docs.limit(0), parser).count() == 0
    only = fit(docs.filter("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in identify(docs.filter("doc_id = 1"), only).collect()} == {("en", 1.0)}
