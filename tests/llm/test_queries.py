"""Each query as it is registered, over the smallest tables: columns, types, and what can be told by plain Python."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from test_search_and_dedup import brute_classes, brute_spans, slow_print

from spliceframe.llm import queries, tokens

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")

TYPES = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_order_minhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_lm_score": "doc_id bigint, n_words bigint, lm_sum double, lm_score double",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_bwt_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_pfair_mixing": "doc_id bigint, source string, mix_block bigint, mix_slot bigint, mix_position bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_host_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    """{name: rows} of all queries, each checked for the columns it must have."""
    out = {}
    for name, f in queries.queries().items():
        df = f(spark, DATA)
        wanted = [tuple(c.split()) for c in TYPES[name].split(", ")]
        assert [t for t in df.dtypes if t in wanted] == wanted, (name, df.dtypes)
        out[name] = df.collect()
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_one_row_for_each_document(results, texts):
    for name, rows in results.items():
        if name not in ("op2_warc", "op12_collocations"):
            assert sorted(r.doc_id for r in rows) == sorted(texts), name


def test_held_out_rows(results):
    for r in results["op1_quality"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_edited_texts(results, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    same = {}
    for r in results["op3_order_minhash"]:
        text, m = texts[r.doc_id], len(texts[r.doc_id]) // 3
        edited = text[: len(text) - m] + texts[after[r.doc_id]][:m]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert same.setdefault(text, r.fingerprint) == r.fingerprint


def test_ids_by_the_library(results, texts):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(tokens.vocabulary()), 0
    for r in sorted(results["op6_token_ids"], key=lambda r: r.doc_id):
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_fingerprints_and_components(results, texts):
    prints = {k: slow_print(x) for k, x in texts.items()}
    keys = sorted(texts)
    least = dict(zip(keys, brute_classes(keys, [prints[k] for k in keys]), strict=True))
    for r in results["op7_simhash"]:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", least[r.doc_id])


def test_removed_bytes(results, texts):
    seen, where = set(), set()
    for x in (t.encode() for t in texts.values()):
        for i in range(len(x) - 399):
            h = hashlib.blake2b(x[i : i + 400], digest_size=16).digest()
            (where if h in seen else seen).add(h)
    for r in results["op8_bwt_repeats"]:
        x = texts[r.doc_id].encode()
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 399):
            if hashlib.blake2b(x[i : i + 400], digest_size=16).digest() in where:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_secret_digests(results, texts):
    kinds = ("assign", "access", "hex")
    for r in results["op10_secret_scan"]:
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in brute_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s.startswith(k) for s in base) for k in kinds]
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == base


def test_rules_by_document(results, texts):
    for r in results["op11_host_rules"]:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id]) if w]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.kept and r.base_failed)
