"""Quality classifier on held-out rows; token files by exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceframe.llm import common, quality, tokens


def labelled(spark, n=400):
    r = random.Random(4)
    words = "the of and river stone green walking under bridge letter paper window".split()
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        lines = []
        for _ in range(r.randrange(1, 9)):
            line = " ".join(r.choice(words) for _ in range(r.randrange(6, 30)))
            lines.append(line.capitalize() + "." if good else r.choice([line.upper() + "!!", line.replace(" ", "%%% "), " ".join([r.choice(words)] * 30)]))
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert len(got) > 50 and got.quality_score.between(0, 1).all()
    assert ((got.quality_score >= quality.THRESHOLD) == (got.quality == 1)).mean() > 0.95
    # labels of the held-out fold are never read
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(docs, flipped).weights, model.weights)


def test_quality_edges(spark, docs, empty):
    _, labels = labelled(spark, 3)
    model = quality.train(empty, labels)
    assert model.curve == (0.0, 0.0)
    assert {r[0] for r in quality.score(docs, model).select("quality_score").collect()} == {0.5}
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, model).count() == docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none).tie == 0.0


def test_marginals_match_enumeration():
    r = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    odds, tie = r.normal(size=8), 0.7
    got, equal = quality.Batch(sizes).marginals(odds, tie)
    want, pairs, at = [], 0.0, 0
    for n in sizes:
        o = odds[at : at + n]
        weights = {}
        for y in np.ndindex(*([2] * n)):
            weights[y] = np.exp(sum(v for v, k in zip(o, y, strict=True) if k) + tie * sum(a == b for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[t]) / z for t in range(n)]
        pairs += sum(w * sum(a == b for a, b in zip(y, y[1:], strict=False)) for y, w in weights.items()) / z
        at += n
    assert np.allclose(got, want) and equal == pytest.approx(pairs)


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [5] * 101, [1, 2] * 50 + [2] * 7, list(range(30)) * 9])
def test_grammar_round_trip(ids):
    a = np.array(ids, dtype=np.uint32)
    seq, rules, first = tokens.compress(a, least=2)
    assert (tokens.expand(seq, rules, first) == a).all()
    pairs = list(zip(seq.tolist(), seq.tolist()[1:], strict=False))
    apart = [p for i, p in enumerate(pairs) if p[0] != p[1] or i % 2 == 0]
    assert len(set(apart)) == len(apart) or len(set(seq.tolist())) == 1  # nothing is left to replace
    if len(rules):
        lengths = tokens.expansion_lengths(rules, first)
        assert tokens.symbol_lengths(seq, lengths, first).sum() == len(a)


def test_random_access():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 9, n).astype(np.uint32) for n in r.integers(1, 4000, 12)]
    out = io.BytesIO()
    tokens.write_shard(out, list(range(12)), parts)
    shard = tokens.Shard(io.BytesIO(out.getvalue()))
    assert len(out.getvalue()) < 4 * sum(map(len, parts))
    for i in r.permutation(12):
        assert (shard.document(i) == parts[i]).all()
    assert (shard.ids() == np.concatenate(parts)).all()
    with pytest.raises(ValueError, match="not a shard"):
        tokens.Shard(io.BytesIO(b"other---" + out.getvalue()))
    none = io.BytesIO()
    tokens.write_shard(none, [], [])
    assert len(tokens.Shard(io.BytesIO(none.getvalue())).ids()) == 0


def test_a_document_reads_its_blocks_alone(monkeypatch):
    """Of many blocks, a document's own are read and unpacked, and of the rules those it meets are written out."""
    monkeypatch.setattr(tokens, "BLOCK", 64)
    r = np.random.default_rng(2)
    words = [r.integers(0, 300, n).astype(np.uint32) for n in r.integers(2, 30, 40)]
    parts = [np.concatenate([words[k] for k in r.integers(0, 40, n)] or [np.zeros(0, np.uint32)]) for n in r.integers(0, 60, 200)]
    out = io.BytesIO()
    tokens.write_shard(out, list(range(200)), parts)
    shard = tokens.Shard(io.BytesIO(out.getvalue()))
    assert len(shard.ends) > 20
    met = []
    plain = tokens.rules_met
    monkeypatch.setattr(tokens, "rules_met", lambda *a: met.append(plain(*a)) or met[-1])
    for i in r.permutation(200):
        before = shard.blocks_read
        assert (shard.document(i) == parts[i]).all()
        first, last = (int(np.searchsorted(shard.samples, shard.starts[i] + k, side="right")) for k in (0, max(len(parts[i]) - 1, 0)))
        assert shard.blocks_read - before <= last - first + 1
    assert np.mean([len(x) for x in met]) < len(shard.rules) / 2 and max(map(len, met)) < len(shard.rules)
    assert (shard.ids() == np.concatenate(parts)).all()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t, own, r = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary()), random.Random(1)
    alphabet = "abcXYZ éÉß 's 't 're 12 ²½ _-%& ’…–\n\t ıİǅ ñ Σσ ́ \x1c\x85 <|endoftext|> 日本 'll've d' "
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(14)))
        assert own.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_equals_the_library_for_every_plain_letter():
    """Each code point that isn't left to the library: alone, inside a word, in capitals, beside digits and quotes."""
    from tokenizers import Tokenizer

    t, own, r = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary()), random.Random(2)
    plain = [c for c in map(chr, range(0x3000)) if tokens.PLAIN.match(c)]
    assert len(plain) > 450
    texts = [x for c in plain for x in (c, f"ab{c}cd", f"ab{c}cd".upper(), c + c, f"x {c} y", f"{c}1{c}'s", f"A{c}")]
    texts += ["".join(r.choice(plain) for _ in range(r.randrange(1, 30))) for _ in range(4000)]
    texts += ["Əliyev", "ƆƐƎ", "Ɓa Ɗa"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_merge_into_themselves():
    """Each token's own bytes merge into that token, by the vocabulary's pairs: what merging by ranks rests on."""
    import json

    with open(tokens.vocabulary(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    rank = {tuple(p): i for i, p in enumerate(pairs)}
    assert len({a + b for a, b in pairs}) == len(pairs)
    for a, b in pairs:
        token = a + b
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, 1 << 30))
            assert best in rank, token
            grown, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    grown.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    grown.append(parts[i])
                    i += 1
            parts = grown
        assert parts == [token]


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    t, own, r = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary()), random.Random(5)
    parts = "the an ción ver keit ñ ß é x qu 1 42 , . … - ' 's n't _ % # ~ Ü É ( ) th er in on st aa aaa \" – ’".split()
    texts = [" ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(40)) for _ in range(500)]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_files_hold_every_document(spark, docs, corpus, empty, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    got = sorted(map(tuple, tokens.round_trip(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    want = sorted((-1 if k is None else k, x or "") for k, x, *_ in corpus)
    assert [g[0] for g in got] == [k for k, _ in want]
    at = 0
    by_start = {}
    for k, start, n, crc in got:
        assert start == at
        at += n
        by_start.setdefault(k, []).append((n, crc))
    for k, x in want:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, tokens.END_ID], dtype="<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in by_start[k]
    assert tokens.round_trip(empty).count() == 0


# ---------------------------------------------------------------- memory of workers


def test_tidily_gives_back_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    @common.tidily
    def doubled(batches):
        for b in batches:
            yield 2 * b

    assert list(doubled(iter([1, 2, 3]))) == [2, 4, 6] and len(calls) == 1
    assert list(doubled(iter([]))) == [] and len(calls) == 2
    cut = doubled(iter([1, 2]))
    next(cut)
    cut.close()
    assert len(calls) == 3


def test_give_back_runs_anywhere(monkeypatch):
    common.give_back()
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: object())  # a C library without malloc_trim
    common.give_back()
