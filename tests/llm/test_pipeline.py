"""The pipeline, stage by stage, against brute force."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_search_and_dedup import brute_classes, brute_contamination, slow_print

from spliceframe.llm import mixing, quality, tokens

WORDS = "the of and river stone green walking under bridge letter paper window summer winter garden".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(6), str(tmp_path_factory.mktemp("sf"))
    exam = " ".join(f"exam{i}" for i in range(20))
    docs, labels = [], []
    for i in range(150):
        good = i % 4 != 0
        text = "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(8, 30))).capitalize() + "." for _ in range(r.randrange(1, 6)))
        if i % 10 == 1:
            text += "\n" + exam + "."
        if not good:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(200 + k, docs[k][1], "en", "src9", docs[k][4]) for k in (2, 3, 5)] + [(300, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text or "" for r in docs.collect()}
    (_, judge), (_, near), (_, clean), (_, blend), (_, write) = corpus_pipeline.STAGES

    def step(f, frame, name):
        f(spark, frame, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = step(judge, docs, "one")
    assert one.columns == columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.scores(model, [t.encode() for t in seen.values()])
    kept = {k for k, s in zip(seen, scores, strict=True) if s >= quality.THRESHOLD}
    assert {r.doc_id for r in one.collect()} == kept
    assert all(k in kept for k in range(150) if k % 4) and not any(k in kept for k in range(0, 150, 4))

    two = step(near, one, "two")
    keys = sorted(kept)
    ids = brute_classes(keys, [slow_print(seen[k]) for k in keys])
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(set(ids))

    three = step(clean, two, "three")
    keys = sorted(set(ids))
    exam = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {k for k, w in zip(keys, brute_contamination([seen[k] for k in keys], exam), strict=True) if w[3]}
    assert bad and three.columns == columns and {r.doc_id for r in three.collect()} == set(keys) - bad

    four = step(blend, three, "four")
    order = [r.doc_id for r in mixing.mix(three, corpus_pipeline.WEIGHTS).orderBy("mix_position").collect()]
    assert four.columns == columns and sorted(order) == sorted(set(keys) - bad)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    got = sorted(write(spark, four, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == order  # the mixture decides the order of the files
    for r in got:
        ids = np.array([*t.encode(seen[r.doc_id], add_special_tokens=False).ids, tokens.END_ID], dtype="<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got))


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_clashing_columns_repeated_rows_and_long_texts(spark, folder, tmp_path):
    names = "mix_file mix_row mix_block mix_slot mix_position n_words contaminated quality_score fp row rn key pipeline_rest".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 or doc_id is null")
    rows = [tuple(r) for r in docs.collect()]
    long = "\n".join(f"The river number {i} runs under bridge {i * 7 % 1009} and garden." for i in range(12000))
    rows += [rows[2], rows[2], (400, long, "en", None, len(long)), (401, "", "", "", 0), (None, None, None, None, None)]
    frame = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], docs.schema.simpleString()[7:-1].replace(":", " ") + "".join(f", {n} string" for n in names))
    want = {f"mix_file{i}": (r[1], tuple(f"{n}{i}" for n in names)) for i, r in enumerate(rows)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{name[:7]}")
        frame, columns = spark.read.parquet(f"{tmp_path}/{name[:7]}"), frame.columns
        assert frame.columns == columns
        for r in frame.collect():  # each row keeps its own text and further columns
            assert want[r.mix_file] == (r.text, tuple(r[n] for n in names))
    left = [r.doc_id for r in frame.collect()]
    assert 400 in left and len(left) == len(set(left))
    got = corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
    assert sorted(map(str, left)) == sorted(str(r.doc_id) for r in got)
