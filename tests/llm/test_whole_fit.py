"""Models learn from all labelled rows: counts of many tasks against those of all rows at once."""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm import piece_codec as P
from tidewell.llm import quality_rules as Q
from tidewell.llm import token_records as T
from tidewell.llm.queries import tokenizer_file


def _labelled(spark, n: int = 700):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 500, 30 + i % 50)) + (" ".join(f" $$${x}!!!" for x in range(40)) if i % 7 == 0 else "") for i in range(n)]
    texts[1] = " ".join(f"word{x}" for x in range(20_000))  # over 64 kB, which samples once passed over
    rows = [(i, t, int(i % 7 != 0)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int"), rows


def test_forest_counts_every_labelled_row(spark):
    table, rows = _labelled(spark)
    known = {r.doc_id for r in table.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").collect()}
    found = [(*Q.statistics(t), y) for i, t, y in rows if i in known]
    x, good = np.array([f for s, f, _ in found if not Q.fails_base(s[0], s[4])]), np.array([y == 1 for s, _, y in found if not Q.fails_base(s[0], s[4])])
    docs = table.select("doc_id", "text")
    forests = [Q.fit_forest(d, table.select("doc_id", "quality"), trees=10, depth=6) for d in (docs.repartition(5), docs.coalesce(1).union(docs.where("doc_id < 9")))]
    splits = Q.random_splits(x.min(axis=0), x.max(axis=0), 10, 6)
    plain = Q.IsolationForest.counted(*splits, np.array([Q.leaf_counts(x[good], f, s) for f, s in zip(*splits, strict=True)]))
    scores = plain.score(x)
    plain.calibrate(x, good)
    for forest in forests:
        assert forest.sample == good.sum() > 256
        assert np.array_equal(forest.score(x), scores)
        assert np.array_equal(forest.keeps(x), plain.keeps(x)) and 0 < forest.keeps(x).mean() < 1


def test_forest_of_few_rows(spark):
    table, _ = _labelled(spark, 40)
    labels = table.select("doc_id", "quality")
    one_good = labels.where("quality = 0 OR doc_id = 2").withColumn("quality", F.when(F.col("doc_id") == 2, 1).otherwise(0))
    for some in (labels.where("quality = 1"), labels.where("quality = 0"), one_good):
        out = Q.quality_report(table.select("doc_id", "text"), some).collect()
        assert len(out) == 40 and any(r.kept for r in out)
    assert Q.fit_forest(table.select("doc_id", "text"), labels.where("false")) is None


def test_workers_free_what_others_have_loaded(monkeypatch):
    """The rules' tasks run in workers that may have held a codec with all its words."""
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda text: f)
    file, batch = tokenizer_file("piece_bpe_32k.model"), pa.array(["some words", None] * 300)
    for function in (Q.verdict("text", None), Q._features("text")):
        seen = P.codec(file)
        assert P.codec(file) is seen and len(common._loaded) == 1
        assert [len(x) for x in function(iter([batch]))] == [600]
        assert not common._loaded
    assert list(common.texts_of(batch)) == batch.to_pylist()


def test_labelled_texts_are_described_once(spark, monkeypatch):
    """A second evaluation takes a second Python worker in each task."""
    monkeypatch.setattr(Q, "materialise", lambda df, label: df)
    rows = [(1, "few words"), (2, " ".join(f"w{x}" for x in range(30))), (2, None), (None, " ".join(f"w{x}" for x in range(40)))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    found = Q.labelled_features(docs, labels)
    assert [(r._features, r._good) for r in found.collect()] == [(Q.statistics(rows[1][1])[1], True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_freed_codecs_are_gone_at_once_and_lean_ones_encode_alike():
    """A codec refers to itself by its tables, and so stayed until Python happened to collect its garbage."""
    file = tokenizer_file("piece_bpe_32k.model")
    gone = weakref.ref(P.codec(file))
    common.unload()
    assert gone() is None
    texts = [" ".join(f"{chr(97 + i % 26)}w{x}thing  {x % 7}" for x in range(i)) for i in range(60)]
    lean, plain = P.PieceCodec(P.Pieces(file), words=5, transitions=50), P.codec(file)
    assert P.codec(file, lean=True).automaton.limit == P.LEAN_TRANSITIONS and len(common._loaded) == 1
    assert [lean.encode(t) for t in texts] == [plain.encode(t) for t in texts]
    assert len(lean.spaced) <= 5 and lean.automaton.size < 500


def test_signs_make_no_new_words():
    """Words behind which signs stand are remembered without them; ids stay the library's, whatever stands side by side."""
    file = tokenizer_file("byte_bpe_50k.json")
    own = T.WordTokens(file)
    plain = own.tokenizer
    random = np.random.default_rng(5)
    parts = ["a", "thing", "don't", "'s", "'", "''ll", ",", "!!", "_", "%%%", "12", "²", "é", "ж", "中", "́", "€", "—", " ", "  ", "\n", "\t", "\xa0", "​", "\x1d", "ǆ", "ɐ", "×", "\\", "]"]
    for _ in range(3000):
        text = "".join(random.choice(parts, random.integers(1, 9)))
        assert own.encode(text) == own._pack(plain.encode(text, add_special_tokens=False).ids), text
    few = T.WordTokens(file)
    few.encode("a thing, a thing; the thing's %thing% (thing) thing!")
    assert not {" thing,", " thing;", " thing's", " thing!"} & few.words.keys()
