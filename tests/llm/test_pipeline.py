import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirespark.llm import bpe, quality
from tests.llm.conftest import texts
from tests.llm.test_operators import expected_groups, plain_lines, plain_mix


def test_stages_against_brute_force(spark, docs):
    """Each stage on the same rows as a plain version: kept rows, cleaned texts, one of each near group, words spent, ids."""
    (_, good), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    first = good(spark, docs, "")
    want = [(i, quality.judge(t)[9]) for i, t in texts() if quality.judge(t)[6]]
    key = lambda rows: sorted(rows, key=repr)
    assert key((r["doc_id"], r["text"]) for r in first.collect()) == key(want)
    # the small corpus goes on whole, so that the later stages have work
    second = lines(spark, docs, "").cache()
    cleaned = plain_lines(texts())
    assert key((r["doc_id"], r["text"] or "") for r in second.collect()) == key((i, t) for i, _, _, t in cleaned)
    assert second.filter(F.length("text") != F.col("n_chars")).filter("text is not null").count() == 0
    third = near(spark, second, "").cache()
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert third.count() == len({(c, f if c is None else None) for _, f, c in expected_groups(rows)})
    fourth = mix(spark, third, "").cache()
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(words(fourth) - words(third)) <= 0 and fourth.columns == docs.columns
    last = encode(spark, fourth, "")
    own = bpe.WordBpe(bpe.vocabulary_path())
    assert key(tuple(r["ids"]) for r in last.collect()) == key(tuple(own.encode(r["text"])) for r in fourth.collect())


def test_first_stage_drops_failing_lines(spark):
    prose = "\n".join(f"Sentence {i} tells of thing{i} and of thing{i * i + 1}, each in turn." for i in range(9))
    junk = "We use cookies here.\nHome | News | Sport | Weather | Shop | Earth\nEVERY WORD OF THIS LINE IS WRITTEN IN CAPITALS\nSentence 0 tells of thing0 and of thing1, each in turn."
    rows = [(1, f"{prose}\n{junk}\nEnd."), (2, prose)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {1: (f"{prose}\nEnd.", len(prose) + 5), 2: (prose, len(prose))}


def test_run_against_brute_force(spark, tmp_path):
    """run() over a written table, and the five stages one after the other in plain Python."""
    import random

    from tokenizers import Tokenizer

    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(90))
    shared = "This very line, of more than forty characters, stands in many of them."
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(12)) + "." for _ in range(8)]
        lines.insert(3, shared)
        lines += ["Home | News | Shop", lines[0]] if i % 4 == 0 else []
        rows.append((i, "\n".join(lines), ("a", "b", None)[i % 3]))
        if i % 5 == 0:
            rows.append((100 + i, rows[-1][1], "b"))
    rows += [(200, "too short", "a"), (None, None, "a"), (201, "BUY!! NOW!! IT!! IS!! ALL!! CHEAP!!\n" * 12, "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(i, quality.judge(t)[9], s) for i, t, s in rows if quality.judge(t)[6]]
    docs = [(i, t, s) for (i, _, s), (_, _, _, t) in zip(docs, plain_lines([d[:2] for d in docs]))]
    groups, kept = {}, []
    for d, (i, f, c) in zip(docs, expected_groups([d[:2] for d in docs])):
        groups.setdefault(c, []).append(d)
    for members in groups.values():
        kept.append(min(members, key=lambda d: d[0]))
    _, _, _, taken, keyed = plain_mix([((i, t), s) for i, t, s in kept])
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for (i, t, s), who in zip(kept, keyed):
        n, size = taken[who], who[2]
        for part in [min(size, n - k * size) for k in range(-(-n // size) if size else 0)]:
            text = t if part == size else " ".join(t.split()[:part])
            ids = lib.encode(text, add_special_tokens=False).ids
            want.append((i, tuple(ids), lib.decode(ids, skip_special_tokens=False)))
    assert sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == sorted(want)
    assert len(kept) < len(docs) < len(rows) and set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "ids", "decoded"}


def test_stages_take_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    out = corpus_pipeline.run(spark, f"/root/testdata/{sf}")
    n = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
    assert 0 < out.count() <= 3 * n and {"doc_id", "ids", "decoded"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None
