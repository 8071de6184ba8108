import pytest

#: Columns whose names operators use for results or inside.
CLASH = ["ids", "size", "shard", "slot", "score", "rep", "token", "n", "line", "template", "block", "links", "component_id", "lang_pred", "held_out"]


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text[, lang, source]) rows -> a documents table with further columns of clashing names."""

    def make(rows, parts=3):
        data = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), *["x"] * len(CLASH)) for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
        return spark.createDataFrame(data, schema).repartition(parts)

    return make
