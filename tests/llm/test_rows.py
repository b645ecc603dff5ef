"""Operators that keep rows keep all their columns, whatever names and types these have."""

from pyspark.sql import functions as F

from sheaf.llm import decontaminate, mixing, quality, simhash


def as_text(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))).collect())


def test_keepers_keep_odder_columns(llm, odder):
    labels = llm.createDataFrame([], "doc_id long, quality int")
    items = llm.createDataFrame([("i", "the quick brown fox jumps over the lazy dog and then it rests for a while")], "item_id string, text string")
    everything = as_text(odder)
    assert as_text(quality.accepted(odder, labels)) == everything
    kept = simhash.keep_one(odder)
    assert kept.columns == odder.columns and set(as_text(kept)) < set(everything)
    fine = decontaminate.clean(odder, items)
    assert fine.columns == odder.columns and set(as_text(fine)) < set(everything)
    assert all("quick brown" not in (r["text"] or "") for r in fine.collect())


def test_mixed_keeps_odder_columns(odder):
    out = mixing.mixed(odder, epochs=3)
    assert out.columns == [*odder.columns, "order_key"]
    rest = [c for c in odder.columns if c != "copy"]
    assert set(as_text(out.select(*["`" + c.replace("`", "``") + "`" for c in rest]))) <= set(as_text(odder.select(*["`" + c.replace("`", "``") + "`" for c in rest])))
    assert out.count() > 0 and out.schema["__n"].dataType.simpleString() == "string"


def test_keep_one_with_text_ids(llm):
    docs = llm.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three"), (None, "four")], "doc_id string, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str) == [("a", "one two three"), (None, "four")]
