"""What the operators promise when tasks run again, when rows are equal, and at the edges of their bounds."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import bpe, covertree, packing, warc


def test_op1_a_rich_lexicon():
    """65,536 words of 40 ids each, no two alike: 2.6 million ids in the pool."""
    words = {b"%05d" % i: tuple(range(i * 40, i * 40 + 40)) for i in range(65_536)}
    lexicon = bpe.Lexicon(bpe.build_lexicon(words))
    assert len(lexicon.pool) > 2_000_000
    for a in range(0, 65_536, 8192):
        part = list(words)[a : a + 8192]
        assert lexicon.find(part) == [np.array(words[w], "<u4").tobytes() for w in part]
    assert lexicon.find([b"99999", b"0000", b"000000"]) == [None] * 3


def test_op1_lexicon_is_bounded_in_bytes(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "LEXICON_BYTES", 9)
    docs = spark.createDataFrame([("the the the the house house house garden garden",)], "text string")
    lexicon = bpe.Lexicon(bpe.fit_lexicon(docs, bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))))
    assert [lexicon.get(w) is not None for w in (b"the", b"house", b"garden")] == [True, True, False]


def test_op3_what_a_lost_attempt_leaves_is_not_read(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" + "y" * (i * 300)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}"
    archives = warc.write_archives(pages, path)
    # a first attempt with other rows in another order, and a file cut short
    lost = warc.write_archives(pages.where("page_id < 40").orderBy(F.desc("page_id")).coalesce(1), path)
    (tmp_path / "part-00000-7-0009.warc.gz").write_bytes((tmp_path / lost.first().file.rsplit("/", 1)[1]).read_bytes()[:50])
    assert len(list(tmp_path.glob("*.warc.gz"))) > archives.count()
    found = warc.reassemble(warc.read_records(spark, archives)).collect()
    assert Counter(bytes(r.payload).decode() for r in found if r.record_type == "response") == Counter({h: 1 for _, _, h in rows}) and len(found) == 60


def test_op5_a_vector_that_many_rows_share(spark):
    """A third of rows have one vector, a third take no part: nothing of either meets in one task, and all are right."""
    base = [[1.0, 0.0], [0.999, 0.001], [0.0, 1.0], [-0.0, 1.0]]
    rows = [(i, base[0], "a") for i in range(500)] + [(1000 + i, base[i % 3 + 1], "a") for i in range(6)] + [(2000 + i, [0.0, 0.0], "a") for i in range(300)] + [(3000, base[0], None), (3001, None, "a"), (None, base[0], "a"), (3002, [float("nan"), 1.0], "a"), (3003, base[0], "b")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    near = 500 + 1 + 2
    assert got[0] == (near - 1, 0, True) and got[499] == (near - 1, 0, False) and got[1000] == (near - 1, 0, False) and got[None] == (near - 1, 0, False)
    assert got[1001] == (3, 1001, True) and got[1005] == (3, 1001, False)
    assert all(got[i] == (0, i, True) for i in (2000, 2299, 3000, 3001, 3002, 3003)) and len(got) == len(rows)


def test_op9_rows_without_id(spark):
    """Equal rows, rows without id and ids with several texts: every piece has a place of its own, and salts part them."""
    import public_tokenizers

    texts = ["one two three"] * 400 + ["four five"] * 100 + ["word " * 3000, "word " * 3001]
    docs = spark.createDataFrame([(None if i < 450 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= 2048
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "doc_id", "text", 2048).where("start = 0").collect())
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert pa.__version__
