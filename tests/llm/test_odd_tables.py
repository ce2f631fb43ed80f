"""Every operator and every pipeline stage over tables that could break it: no rows, ids of text, copies, columns of any name."""

from collections import Counter

import corpus_pipeline
import pytest
from ledgerloom.llm import decontamination, language_id, mixing, neighbours, ngram_join, quality, sharding, token_counts, toxicity, url_filter
from pyspark.sql import functions as F

#: Names that operators use inside, and others that are hard to write.
NAMES = """_row _t _text _id _bad _gone _twice _label_id _y _k0 _k1 _source _of _key _range _group _sig _item _h _doc _near _host _path _template _seg _label _keep0 _c0 _lang _bytes
_stay_id _none _at _left _salt _cell _times _predicted _score score predicted size taken target shard slot n_shingles component_id held_out node root key sig a b""".split() + ["my col", "a.b", "x-y", "é", "struct<a:int>"]
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards pack my box with five dozen jugs of ink".split()
LONG = " ".join(WORDS * 3)
TEXTS = [LONG, LONG, LONG + " end", None, "", " \n", "one", "moron scum " + LONG[:60], "123 !!", "é" * 50, LONG * 200] + [" ".join(WORDS[i:] + WORDS[:i]) for i in range(12)]


def odd(spark, ids="text"):
    rows = [({"text": None if i == 3 else f"id {i % 9}", "long": None if i == 3 else i % 9}[ids], t, ["en", "de", None][i % 3], ["a", None, ""][i % 3]) for i, t in enumerate(TEXTS)]
    rows += rows[:3] + [rows[3]] * 4
    d = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'text' else 'long'}, text string, lang string, source string")
    return d.select("*", *[F.lit(f"v {n}").alias(n) for n in NAMES if n not in ("size", "score")], F.lit(1.5).alias("score"), F.lit(7).alias("size")).repartition(3)


def labels(spark, ids="text"):
    rows = [(f"id {i}" if ids == "text" else i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), ("id 1" if ids == "text" else 1, 0, None)]
    return spark.createDataFrame(rows, f"doc_id {'string' if ids == 'text' else 'long'}, quality int, toxic int").withColumns({n: F.lit("x") for n in ("_label_id", "_y", "text", "my col")})


def bench(spark):
    return spark.createDataFrame([(0, " ".join(WORDS[:12])), (1, None), (2, "")], "item_id long, text string").withColumn("my col", F.lit(1))


OPERATORS = {
    "decontamination": lambda s, d, k: decontamination.find_leaks(d, bench(s)),
    "remove_leaks": lambda s, d, k: decontamination.remove_leaks(d, bench(s)),
    "sharding": lambda s, d, k: sharding.shard_documents(d, 4),
    "language_id": lambda s, d, k: language_id.identify(d, F.lit(True)),
    "components": lambda s, d, k: ngram_join.jaccard_components(d),
    "keep_one": lambda s, d, k: ngram_join.keep_one(d),
    "mixing": lambda s, d, k: mixing.mix_sources(d),
    "token_counts": lambda s, d, k: token_counts.count_tokens(d),
    "quality": lambda s, d, k: quality.score_quality(d, labels(s, k), F.lit(True)),
    "toxicity": lambda s, d, k: toxicity.apply(d, toxicity.train(d, labels(s, k), F.lit(True))),
    "urls": lambda s, d, k: url_filter.filter_urls(d.withColumn("url", F.concat(F.lit("http://h/"), "text")), keep=["doc_id"]),
    "neighbours": lambda s, d, k: neighbours.nearest(d.select("*", F.hash("text").cast("long").alias("vec_id"), F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding")), F.col("vec_id") % 2 == 0, 3),
}
PER_ROW = {"sharding", "language_id", "components", "mixing", "token_counts", "quality", "toxicity", "urls"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_tables(spark, name):
    for ids in ("text", "long"):
        d = odd(spark, ids)
        found = OPERATORS[name](spark, d, ids).collect()
        assert len(found) == d.count() if name in PER_ROW else len(found) > 0
        if name in PER_ROW:
            column = "page_id" if "page_id" in found[0] else "doc_id"
            assert Counter(r[column] for r in found) == Counter(r[0] for r in d.select("doc_id").collect())
    none = OPERATORS[name](spark, d.limit(0), "long")
    assert none.count() == 0 and none.columns


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_tables(spark, tmp_path, stage):
    name, function = stage
    for n, ids in enumerate(("text", "long")):
        place = str(tmp_path / ids)
        d = odd(spark, ids).drop("struct<a:int>")
        d.write.parquet(f"{place}/documents.parquet")
        labels(spark, ids).write.parquet(f"{place}/labels.parquet")
        bench(spark).write.parquet(f"{place}/benchmark.parquet")
        docs = spark.read.parquet(f"{place}/documents.parquet")
        out = function(spark, docs, place)
        kept = out.collect()
        assert 0 < len(kept) <= 2 * docs.count() and (out.columns == docs.columns or name == "sharding")
        if name not in ("sharding", "mixing"):
            rows = Counter(map(tuple, docs.collect()))
            assert not Counter(map(tuple, kept)) - rows
            assert {r["doc_id"] for r in kept if not r["text"]} == {r["doc_id"] for r in docs.collect() if not r["text"]}  # without a text nothing is found
        assert function(spark, docs.limit(0), place).count() == 0
