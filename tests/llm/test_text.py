import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import classifier, mixing, pieces, planes, rules, secrets, textstats

from .edge import ROWS, docs, empty

SF = "/root/testdata/sf0.001"
PIECES, WORDS = str(P.path("piece_bpe_32k.model")), str(P.path("word_bpe_49k.json"))


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#<\xa0é", max_size=60))
def test_base_statistics(text):
    assert textstats.base_stats(text)[:5] == brute_base(text)


def test_rules_on_edge_rows(spark):
    got = rules.apply(docs(spark), [])
    assert sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got.collect()) == sorted(repr((r[0], *brute_base(r[1]))) for r in ROWS)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in got.collect())
    assert rules.apply(empty(spark), []).isEmpty()
    d = docs(spark)
    kept = rules.keep_good(d, [])
    assert kept.columns == d.columns and kept.isEmpty()  # all are short or repeat themselves


def test_learned_list_separates_and_is_ordered(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    bad = (x[:, 0] > 1.2) | ((x[:, 1] < -0.5) & (x[:, 2] > 0.8))
    learned = rules.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(3000, bool)
    for r in learned:
        hit |= rules.covers(r, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).sum() < 0.01 * (~bad).sum()
    df = spark.createDataFrame(x[:200].tolist(), "a double, b double, c double").withColumn("rule", rules.as_column(learned, {n: F.col(n) for n in "abc"}))
    first = [next((i for i, r in enumerate(learned, 1) if rules.covers(r, v[None], ["a", "b", "c"])[0]), 0) for v in x[:200]]
    assert [r["rule"] for r in df.collect()] == first
    assert rules.learn(x, np.zeros(3000, bool), ["a", "b", "c"]) == []


def test_rules_and_classifier_on_labelled_documents(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rules.apply(d, rules.fit(d, labels)).join(labels, "doc_id").filter("NOT base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95
    scored = classifier.classify(d, labels).join(labels, "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def brute_rules(x, bad, names):
    """The verdict of a decision list learned by the definition, with plain loops: no sorting, no running sums."""
    holds = lambda rule, i: all((x[i][j] > cut) == above for j, above, cut in rule)

    def one(left, fold):
        grow, prune = [i for i in left if i % 3 != fold], [i for i in left if i % 3 == fold]
        rule, live = [], grow
        cuts = [sorted({x[i][j] for i in grow}) for j in range(len(names))]
        cuts = [[(a + b) / 2 for a, b in zip(c, c[1:])] or [0.0] for c in cuts]
        while len(rule) < 4 and any(not bad[i] for i in live):
            p0, n0, best = sum(bad[i] for i in live), len(live), (1e-9, None)
            for j in range(len(names)):
                for above in (False, True):
                    for cut in cuts[j]:
                        hit = [i for i in live if (x[i][j] > cut) == above]
                        p = sum(bad[i] for i in hit)
                        gain = p * (np.log2(p / len(hit)) - np.log2(p0 / n0)) if p else 0.0
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, above, cut))
            if best[1] is None:
                break
            j, above, cut = best[1]
            low, high = [x[i][j] for i in live if x[i][j] <= cut], [x[i][j] for i in live if x[i][j] > cut]
            rule.append((j, above, (max(low) + min(high)) / 2 if low and high else cut))
            live = [i for i in live if holds(rule[-1:], i)]
        if not rule:
            return None

        def value(r):
            hit = [i for i in prune if holds(r, i)]
            return sum(1 if bad[i] else -1 for i in hit) / max(1, len(hit))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (value(r), -len(r)))
        hit, pruned = [i for i in left if holds(rule, i)], [i for i in prune if holds(rule, i)]
        laplace = lambda rows_: (sum(bad[i] for i in rows_) + 1) / (len(rows_) + 2)
        right = sum(bad[i] for i in hit)
        ok = len(hit) >= rules.MIN_COVER and right >= rules.PRECISION * len(hit) and laplace(hit) >= rules.LAPLACE and laplace(pruned) >= rules.LAPLACE_PRUNING
        return rule if ok else None

    left, learned = list(range(len(x))), []
    while sum(bad[i] for i in left) >= rules.MIN_COVER:
        rule = one(left, 2) or one(left, 1) or one(left, 0)
        if rule is None:
            break
        learned.append(rule)
        left = [i for i in left if not holds(rule, i)]
    return [next((k for k, r in enumerate(learned, 1) if holds(r, i)), 0) for i in range(len(x))]


@pytest.mark.parametrize("seed", range(3))
def test_learned_verdict_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (240, 3)) / 8
    bad = (x[:, 0] > 3.5) | ((x[:, 1] < 1) & (x[:, 2] > 2))
    bad[:3] ^= True
    learned = rules.learn(x, bad, ["a", "b", "c"])
    got = [next((k for k, r in enumerate(learned, 1) if rules.covers(r, v[None], ["a", "b", "c"])[0]), 0) for v in x]
    assert got == brute_rules(x.tolist(), bad.tolist(), "abc") and max(got) >= 2


def test_rules_of_string_ids(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert rules.apply(d, rules.fit(d, labels)).filter("rule > 0").count() > 0


def test_classifier_against_a_direct_solve(spark):
    """The whole query: one matrix, one solve and a quadratic calibration instead of partition sums and pooled bins."""
    from stratalog.llm.common import written

    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    names = list(textstats.shares())
    rows = textstats.with_stats(d).select("doc_id", *(c.cast("double").alias(n) for n, c in textstats.shares().items())).toPandas()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids, x = rows["doc_id"].tolist(), rows[names].to_numpy(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in ids])
    y = np.array([quality.get(i, np.nan) for i in ids], float)
    known = ~np.isnan(y) & (fold != 2)
    mean, scale = x[known].mean(axis=0), x[known].std(axis=0)
    rng = np.random.default_rng(7)
    w, phase = rng.normal(size=(len(names), 256)) / np.sqrt(len(names) / 2), rng.uniform(0, 2 * np.pi, 256)
    z = np.hstack([np.cos(np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -3, 3) @ w + phase) * np.sqrt(2 / 256), np.ones((len(x), 1))])
    fit, cal = known & (fold < 2), known & (fold == 3)
    # Ridge as least squares with added rows.
    extra = np.sqrt(1e-3 * fit.sum() / 256) * np.eye(257)
    beta = np.linalg.lstsq(np.vstack([z[fit], extra]), np.r_[y[fit], np.zeros(257)], rcond=None)[0]
    raw = z @ beta
    at = np.clip(((raw[cal] + 0.5) / 2 * 4096), 0, 4095).astype(int)
    bins = sorted(set(at))
    mean_of, size_of = [y[cal][at == b].mean() for b in bins], [(at == b).sum() for b in bins]
    # Isotonic by its max-min formula.
    avg = lambda i, j: np.average(mean_of[i : j + 1], weights=size_of[i : j + 1])
    value = [max(min(avg(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    want = np.clip(np.interp(raw, -0.5 + (np.array(bins) + 0.5) * 2 / 4096, value), 0, 1)
    got = {r["doc_id"]: r["score"] for r in written(classifier.classify(d, labels), "test-scores").collect()}
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-4


def test_classifier_on_edge_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs(spark), none).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1), (5, 0), (8, None), (None, 1), (9, 1)], "doc_id long, quality int")
    got = classifier.classify(docs(spark), few).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert classifier.classify(empty(spark), few).isEmpty()


def test_pool_adjacent_violators():
    assert classifier.pav(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0, 3.0])).tolist() == [0.5, 0.5, 1.25, 1.25]


@pytest.fixture(scope="module")
def models():
    return pieces.PrefixTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abe the▁ing.,0é中\U0001f600́\n", max_size=40))
def test_prefix_table_equals_the_library(models, text):
    table, sp = models
    text = text.encode("utf-8", "ignore").decode()
    ids = sp.encode(text)
    assert table.encode(text) == ids and table.decode(ids) == sp.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=8))
def test_decoding_any_ids(models, ids):
    table, sp = models
    if 0 not in ids:  # the library spells unknown ids by their neighbours
        assert table.decode(ids) == sp.decode(ids)


def test_compatibility_is_what_merging_gives(models):
    import random

    table, rng = models[0], random.Random(2)
    ids = [i for i in range(259, 32_000) if i in table.halves or len(table.text[i]) == 1]
    for _ in range(5_000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert table.compatible(a, b) == (table.merged(table.text[a] + table.text[b]) == [table.text[a], table.text[b]])


def test_pieces_on_edge_rows(spark, models):
    sp = models[1]
    want = []
    for i, t, *_ in ROWS:
        ids = sp.encode(t or "")
        want.append(repr((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids)))
    got = pieces.encode_documents(docs(spark), PIECES)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)
    back = pieces.decode_documents(got, PIECES)
    assert sorted(repr(tuple(r)) for r in back.collect()) == sorted(repr((r[0], r[1] or "")) for r in ROWS)
    assert pieces.encode_documents(empty(spark), PIECES).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=70), st.sampled_from([1, 8]))
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u4")
    assert planes.from_planes(planes.to_planes(a, bits), len(a), bits).tolist() == ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="aB'sé́ \n1,.!Σς\x1c²½İ", max_size=30))
def test_word_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    encoder = planes.loaded(WORDS)
    for t in (text, text + "<|endoftext|> It's"):
        assert encoder.encode(pa.array([t]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_of_other_scripts_and_many_texts_at_once():
    encoder = planes.Encoder(WORDS)
    texts = ["Привет, МИР! Привет", "a日本語 b", "", "Ünïcode ΣΑΣ ς", "x\x1fy z", "It's <|endoftext|> é", "e\u0301 \u0301a", "a\u2003b\xa0c"] * 2
    for part in (slice(0, 16), slice(5, 9), slice(15, 16), slice(3, 3)):
        ids, counts = encoder.encode(pa.array(texts, pa.string())[part])
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts[part], add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert [len(s) for s in planes._slices(pa.array(["x" * n for n in (planes.SLICE, 5, 0, planes.SLICE - 5, 1, 2 * planes.SLICE, 3)]))] == [1, 3, 1, 1, 1]


@pytest.mark.parametrize("change", [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("suffix", "")])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json

    spec = json.load(open(WORDS))
    if change[0] == "suffix":
        spec["model"] |= {"end_of_word_suffix": None, "vocab": {"a": 0}, "merges": []}
    else:
        spec[change[0]] = change[1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        planes.Encoder(str(tmp_path / "t.json"))


@pytest.mark.parametrize("bits", [1, 8])
def test_id_files_on_edge_rows(spark, tmp_path, bits):
    tok = Tokenizer.from_file(WORDS)
    table = planes.write_ids(docs(spark), WORDS, 2, f"file://{tmp_path}/ids", block=1000, plane_bits=bits)
    ordered = sorted((r[:2] for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append(repr((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))))
        start += len(ids)
    assert sorted(repr(tuple(r)) for r in planes.read_crcs(planes.with_starts(table)).collect()) == sorted(want)
    ids = {r["doc_id"]: r["ids"] for r in planes.read_ids(table).filter("doc_id IS NOT NULL").collect()}
    assert ids[5] == tok.encode(ROWS[4][1], add_special_tokens=False).ids + [2]
    assert planes.read_crcs(planes.with_starts(planes.write_ids(empty(spark), WORDS, 2, f"file://{tmp_path}/none"))).isEmpty()


def test_an_unfinished_file_is_refused(tmp_path):
    import pyarrow.fs as fs

    (tmp_path / "x").write_bytes(b"BITPLAN1" + b"\0" * 40)
    with pytest.raises(ValueError):
        planes.Reader(fs.LocalFileSystem().open_input_file(str(tmp_path / "x")))


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "api", "key", "ſecret", "toKen", "=", ":", " ", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "0123456789abcdef", "g", "é", "K"]), max_size=14))
def test_base_spans_match_the_plain_patterns(parts):
    text = "".join(parts)
    assert sorted(secrets.base_spans(text)) == sorted(brute_secrets(text))


SECRET = 'password = "hunter2secret"'


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(urllib.parse.quote(s).encode())).decode(),
        lambda s: urllib.parse.quote(urllib.parse.quote(base64.b64encode(s.encode()).decode())),
    ],
)
def test_layers_are_unwrapped_and_mapped(wrap):
    inner = f"xx {SECRET} yy"
    text = f"é before {wrap(inner)} after"
    base, added, chains, cut = secrets.scan(text)
    assert chains and not cut and not any(s[0] == "assign" for s in base)
    kind, a, b = next(s for s in added if s[0] == "assign")
    assert text.index(wrap(inner)) <= a < b <= text.index(" after")


def test_quoted_layer_maps_to_the_exact_characters():
    text = "see " + urllib.parse.quote("token: abcdef99 end")
    (span,) = secrets.scan(text)[1]
    assert text[span[1] : span[2]] == "token%3A%20abcdef99"


def test_cycles_end_and_plain_texts_have_no_layers():
    assert secrets.scan("100%25" * 50)[1] == []
    assert secrets.scan("just words " * 1000)[2] == []


def test_equal_blobs_each_give_spans():
    for wrap in (lambda s: base64.b64encode(s).decode(), lambda s: base64.b64encode(gzip.compress(s, mtime=0)).decode()):
        blob = wrap(b"password=hunter2secret")
        text = f"first {blob} middle {blob} end {urllib.parse.quote(blob + ' ')}"
        at = [i for i in range(len(text)) if text.startswith(blob.rstrip("="), i)]
        added = secrets.scan(text)[1]
        assert len(at) == 3 and all(any(i <= a < b <= i + len(blob) + 4 for _, a, b in added) for i in at)


@pytest.mark.parametrize("secret", ["token=abc123", "token=12345678", "secret=abcdef", "api_key=abcdef"])
def test_shortest_secrets_in_base64(secret):
    once = base64.b64encode(secret.encode()).decode()
    for blob in (once, base64.b64encode(once.encode()).decode()):
        text = f"a {blob} b"
        assert [(k, a) for k, a, b in secrets.scan(text)[1] if 2 + len(blob) - 4 <= b <= 2 + len(blob)] == [("assign", 2)]


def lined(blob, end, width=64):
    return end.join(blob[i : i + width] for i in range(0, len(blob), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    "])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, zstandard.compress])
def test_wrapped_base64(end, pack):
    noise = "".join(hashlib.sha256(bytes([i])).hexdigest()[:20] + "\n" for i in range(20))
    for at in range(40, 50):
        inner = f"{noise}{'x' * at} {SECRET} {noise}"
        blob = lined(base64.b64encode(pack(inner.encode())).decode().rstrip("="), end)
        text = f"see the\n{blob}\nafter that"
        _, added, _, cut = secrets.scan(text)
        assert cut == 0 and any(k == "assign" and text.index(blob) <= a < b <= text.index(blob) + len(blob) + 1 for k, a, b in added)


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zstandard.compress])
@pytest.mark.parametrize("glue", ["path/", "a/", "ab_", "x-y-z_", ""])
def test_runs_glued_to_other_characters(glue, pack):
    for tail in ("", "A", "/x", "_ab", "=", "=="):
        text = f"in {glue}{base64.b64encode(pack(SECRET.encode())).decode().rstrip('=')}{tail} end"
        _, added, _, cut = secrets.scan(text)
        assert cut == 0 and any(k == "assign" and a >= 3 + len(glue) - 1 for k, a, b in added)


def test_a_stream_without_its_end_is_reported():
    noise = "".join(hashlib.sha256(bytes([i])).hexdigest() + "\n" for i in range(200))
    for pack in (gzip.compress, zlib.compress, zstandard.compress):
        blob = base64.b64encode(pack(noise.encode())).decode()
        assert secrets.scan(f"a {blob} b")[3] == 0 and secrets.scan(f"a {blob[:4000]} b")[3] == 1


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.compress])
def test_all_of_a_stream_is_scanned(pack):
    late = b"filler words " * 3_000_000 + SECRET.encode() + b" filler words" * 10
    for raw in (pack(late), pack(b"x") + pack(SECRET.encode()), pack(b"x") * 30 + pack(SECRET.encode()), pack(pack(b"y") + pack(SECRET.encode()))):
        blob = base64.b64encode(raw).decode()
        _, added, _, cut = secrets.scan(f"a {blob} b")
        assert cut == 0 and any(k == "assign" and a == 2 and 2 + len(blob) - 4 <= b <= 2 + len(blob) for k, a, b in added)


@pytest.mark.parametrize("size", [(8 << 20) - 8, 8 << 20, (16 << 20) - (1 << 20) - 5])
def test_secrets_at_the_edge_of_a_window(size):
    nested = base64.b64encode(gzip.compress(hashlib.sha256(b"1").digest() * 3 + SECRET.encode())) + b" "
    for secret in (SECRET.encode(), nested):
        blob = base64.b64encode(zlib.compress(b" " * size + secret + b" " * 99, 1)).decode()
        assert [s[0] for s in secrets.scan(f"a {blob} b")[1]] == ["assign"]


def test_text_that_starts_like_a_stream():
    blob = base64.b64encode(gzip.compress(f"x^2 + 1 {SECRET}".encode())).decode()
    assert [s[0] for s in secrets.scan(f"a {blob} b")[1]] == ["assign"]


def test_secrets_on_edge_rows(spark):
    got = secrets.find_secrets(docs(spark))
    assert got.count() == len(ROWS) and got.filter("spans <> ''").isEmpty()
    assert secrets.find_secrets(empty(spark)).isEmpty()


def test_secrets_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: secrets.spelled(brute_secrets(r["text"])) for r in rows.collect()}
    got = secrets.find_secrets(rows).collect()
    assert {r["doc_id"]: r["base_spans"] for r in got} == want and any(want.values())


def test_mixing_on_edge_rows(spark):
    d = docs(spark)
    got = mixing.mix(d, seed=1)
    assert set(d.columns) | {"n_copies", "copy_no", "shuffle_key"} == set(got.columns)
    assert mixing.mix(empty(spark)).isEmpty()
    own = d.withColumn("n_copies", F.lit("own"))
    again = mixing.mixed_rows(own, seed=1)
    assert again.columns == own.columns and {r["n_copies"] for r in again.collect()} == {"own"}
    keys = [r["shuffle_key"] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)  # partitions hold consecutive ranges
    assert mixing.mix(d, weights={"a": 1.0}).filter("source <> 'a' OR source IS NULL").isEmpty()


def test_poisson_counts(spark):
    import math

    for rate in (0.3, 2.5, 40.0):
        rows = spark.range(20_000).select(mixing.poisson_count(F.lit(rate), 42, F.col("id").cast("string")).alias("n")).groupBy("n").count().collect()
        n = {r["n"]: r["count"] for r in rows}
        mean = sum(k * c for k, c in n.items()) / 20_000
        var = sum((k - mean) ** 2 * c for k, c in n.items()) / 20_000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 20_000) and abs(var / rate - 1) < 0.06
        k = int(rate)
        p = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert abs(n.get(k, 0) / 20_000 - p) < 0.015


def test_mixture_reaches_the_weights(spark):
    rows = [(i, "x" * 99, "en", "hot" if i % 3 else f"s{i % 4}", 99) for i in range(6000)]
    share = mixing.mix(docs(spark, rows, extra=False), weights={"hot": 1.0, "s0": 1.0, "s1": 2.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in share}
    total = sum(n.values())
    assert abs(total - 6000) < 400 and set(n) == {"hot", "s0", "s1"}
    assert abs(n["s1"] / total - 0.5) < 0.05 and abs(n["hot"] / total - 0.25) < 0.05
