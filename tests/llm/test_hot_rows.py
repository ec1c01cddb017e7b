"""Very many equal rows: split, joined by broadcast, and still whole."""

import collections

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from morphlake.llm import op2_curriculum_mix as op2
from morphlake.llm import op4_lsh_forest_join as op4
from morphlake.llm import op9_context_tree_weighting as op9

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS).repartition(5)


def test_equal_rows_get_hashes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(op2, "HOT_ROWS", 50)
    rows = [(7, "same words here", "a")] * 300 + [(i, f"w{i} " * (i % 9 + 1), "ab"[i % 2]) for i in range(200)] + [(8, "few", "b")] * 20
    docs = docs_of(spark, rows)
    mixed = op2.curriculum_mix(docs).collect()
    assert len(mixed) == len(rows) and collections.Counter((r.doc_id, r.source) for r in mixed) == collections.Counter((i, s) for i, _, s in rows)
    for source in "ab":
        own = [r for r in mixed if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 9 and all(r.taken <= 3 * r.size for r in own)
    again = op2.curriculum_mix(docs.coalesce(2)).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.positions or ())) for r in again) == sorted((r.doc_id, r.taken, tuple(r.positions or ())) for r in mixed)
    hashes = op2._spread(docs.select(F.xxhash64("doc_id", "text").alias(op2.HASH), "doc_id"))
    assert hashes.where("doc_id = 7").select(op2.HASH).distinct().count() == 301 and hashes.where("doc_id = 8").select(op2.HASH).distinct().count() == 2


def test_copies_beyond_the_limit_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op4, "HOT_COPIES", 30)
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(100 + i, text, "s") for i in range(80)] + [(i, None if i % 2 else "?!", "s") for i in range(60)] + [(90, text + " more words", "s"), (91, "alone " * 9, "s"), (91, "alone " * 9, "s")]
    got = collections.Counter((r.class_id, r.n_links, r.n_copies) for r in op4.jaccard_join(docs_of(spark, rows)).where("n_shingles > 0").collect())
    assert got == {(90, 80, 80): 80, (90, 80, 1): 1, (91, 1, 2): 2} or got == {(90, 80, 80): 80, (90, 80, 1): 1, (91, 0, 1): 2}
    alone = op4.jaccard_join(docs_of(spark, rows)).where("n_shingles = 0").collect()
    assert len(alone) == 60 and all((r.class_id, r.n_links, r.n_copies) == (r.doc_id, 0, 1) for r in alone)
    assert sorted(r.doc_id for r in op4.one_of_each_group(docs_of(spark, rows)).collect()) == [*range(60), 90, 91]


def test_a_group_of_many_sequences_is_taken_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    group = 0x616263
    low = np.unique(rng.integers(0, 40, 9000).astype(np.uint32) * 65536 + rng.integers(0, 256, 9000).astype(np.uint32) * 256 + rng.integers(97, 110, 9000).astype(np.uint32))
    row = {"grp": [group], "keys": [low.tobytes()], "n": [rng.integers(0, 5, len(low)).astype(np.int64).tobytes()], "context": [group >> 8], "nodes": [np.arange(1, 256)], "q": [rng.random(255) / 2], "r": [np.full(255, 0.4)]}
    frame = pd.DataFrame(row)

    def results():
        sums = pd.concat(op9._shared_nodes(iter([frame]))).sort_values(["context", "node"], ignore_index=True)
        return sums, np.frombuffer(pd.concat(op9._values(iter([frame])))["n"].iloc[0])

    sums, values = results()
    monkeypatch.setattr(op9, "MOST_CODES", 700)
    codes, _, _ = op9._codes_of(frame)
    assert len(op9._slices(codes)) > 5
    sliced, again = results()
    assert np.allclose(values, again, rtol=1e-12, atol=1e-12) and np.allclose(sums.to_numpy(dtype=float), sliced.to_numpy(dtype=float), rtol=1e-12)
