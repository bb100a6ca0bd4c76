import hashlib
import zlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratalog.llm.queries import ORACLES, QUERIES
from stratalog.llm.queries import tokenizer_path
from tests.oracle import compare, connect

from .test_dedup import brute_components
from .test_text import brute_base, brute_secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    """The result of a registered query, by document."""
    found = QUERIES[name](spark, SF).collect()
    out = {r["doc_id"]: r for r in found}
    assert len(out) == len(found)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    got = rows(spark, "op1_quality_rules")
    assert set(got) == set(texts)
    for i, r in got.items():
        words, chars, symbols, lines, repeats = brute_base(texts[i])
        failed = words < 50 or 100 * repeats > 50 * words
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (words, chars, symbols, lines, repeats, failed)
        assert r["kept"] == (not failed and r["rule"] == 0)


def test_op3(spark, texts):
    from stratalog.llm import secrets

    got = rows(spark, "op3_secret_scan")
    for i, r in got.items():
        base = brute_secrets(texts[i])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in secrets.KINDS]
        assert r["base_sha256"] == sha(secrets.spelled(base)) and set(secrets.spelled(base).split(",")) <= set(r["spans"].split(","))
    assert set(got) == set(texts)


def test_op4(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = rows(spark, "op4_sentencepiece")
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = sp.encode(texts[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op5(spark, texts):
    import numpy as np

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got, start = rows(spark, "op5_id_planes"), 0
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6(spark, texts):
    got = rows(spark, "op6_quality_classifier")
    assert set(got) == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_op7(spark, texts):
    got = rows(spark, "op7_pii_surrogates")
    assert set(got) == set(texts) and all((r["n_entities"] == 0) <= (r["text"] == texts[i]) for i, r in got.items())


def test_op8(spark, texts):
    got = rows(spark, "op8_simhash_near_dedup")
    assert sorted(repr((i, int(r["fingerprint"], 16), r["component_id"])) for i, r in got.items()) == brute_components(list(texts.items()))
