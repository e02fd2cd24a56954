"""What is shuffled when a model is written or comes from parallel arrays."""

import re

from ctxvote.lineage import cut
from ctxvote.operators import model
from ctxvote.sources import corpus


def _exchanges(df):
    return re.findall(r"^.*\b(?:Exchange hashpartitioning|SortMergeJoin).*$", df._jdf.queryExecution().executedPlan().toString(), re.M)


def test_labels_of_flat_arrays_are_looked_up_after_the_only_shuffle(spark):
    rows = spark.createDataFrame([(2, "h", "variable", 5, [1, 0, 9], [3, 2, 1])], "n int, hash string, kind string, total long, typ array<long>, counts array<long>")
    vocab = spark.createDataFrame([("variable", 0, "a"), ("variable", 1, "b")], "kind string, id int, label string")
    back = corpus.nested_from_flat_arrays(rows, 3, vocab)
    assert len(_exchanges(back)) == 1
    assert [(p.label, p["count"]) for p in back.first().preds] == [("b", 3), ("a", 2)]


def test_a_placed_model_is_not_shuffled_again(spark, tmp_path):
    entries = spark.createDataFrame([(1, ["a", "@@v@@", "b"], {"type": {"v": (True, "int")}})], "entry_id long, tokens array<string>, labels map<string,map<string,struct<human:boolean,label:string>>>")
    nested = model.nested(model.build_model(entries, cut(model.build_vocab(entries)), sizes=(2,)))
    assert len(_exchanges(nested.sortWithinPartitions("n", "hash"))) == 1
    corpus.write_model(nested, str(tmp_path / "m"), {}, placed=True)
    assert corpus.read_model(spark, str(tmp_path / "m"), {}).count() == 2
