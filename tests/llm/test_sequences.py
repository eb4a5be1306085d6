"""Streaming BPE, fill-in-middle and periodic runs against the library, plain slicing and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from cases import frame, odd_rows, prose

from spendlens.llm import bpe_stream, fim, periodic, queries


@pytest.fixture(scope="module")
def documents(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    return [(r[0] + 1000, *r[1:]) for r in rows] + odd_rows()


@pytest.fixture(scope="module")
def docs(spark, documents):
    return frame(spark, documents).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# streaming BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe_stream.Encoder(vocabulary[0])


def test_bpe_documents(docs, documents, nothing, vocabulary):
    library = vocabulary[1]
    want = Counter()
    for doc, text, *_ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    both = bpe_stream.round_trip(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both) == want
    apart = bpe_stream.decode_ids(bpe_stream.encode_documents(docs)).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in apart) == want
    assert bpe_stream.round_trip(nothing).count() == bpe_stream.encode_documents(nothing).count() == 0


def test_bpe_odd_texts(encoder, vocabulary):
    library, rng = vocabulary[1], random.Random(5)
    texts = [
        "it's WE'LL don't 'S <|endoftext|>x<|startoftext|> <|endof",
        "İstanbul ΣΑΣ ſ ǅ é é \u0085x y ﬁ ½ ² ٣ \x00\x01 \U0001f600!!??",
    ]
    for alphabet in ("ab", "abc", "aeinorst", "aàéö", " a.'st<|", "ΣσΑİıñ́ ", "abcdefghijklmnopqrstuvwxyz", "日本語の"):
        texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(60)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, text


def test_bpe_long_pre_token_in_constant_memory(encoder, vocabulary):
    """Pre-tokens far longer than the lookahead: the same ids, and a buffer of fixed size."""
    merges, library = encoder.merges, vocabulary[1]
    for alphabet in ("a", "ab", "inthe", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(random.Random(6).choices(alphabet, k=40_000))
        machine, out, most = bpe_stream.Transducer(merges, block=100), [], 0
        symbols = text[:-1] + chr(ord(text[-1]) + bpe_stream._WORD_END)
        for i in range(0, len(symbols), 100):
            out += machine.feed(symbols[i : i + 100])
            most = max(most, len(machine.symbols))
        assert out + machine.finish() == library.encode(text, add_special_tokens=False).ids
        assert most <= merges.lookahead + 100 + merges.longest_token


def test_lookahead_is_sufficient():
    """Over small merge lists: what is emitted before the end never changes with what follows."""
    from tokenizers import Tokenizer, models

    rng = random.Random(9)
    for _ in range(150):
        symbols = list("abc")
        merges = []
        while len(merges) < 8:
            pair = (rng.choice(symbols), rng.choice(symbols))
            if "".join(pair) not in symbols and len("".join(pair)) < 7:
                merges.append(pair)
                symbols.append("".join(pair))
        vocab = {t: i for i, t in enumerate(symbols)}
        library = Tokenizer(models.BPE(vocab, merges))
        table = bpe_stream.Merges(vocab, merges, "")
        for _ in range(40):
            text = "".join(rng.choices("abc" if rng.random() < 0.7 else "ab", k=rng.randint(1, 40)))
            machine, out = bpe_stream.Transducer(table, block=1), []
            for c in text:
                out += machine.feed(c)
            assert out + machine.finish() == library.encode(text).ids, (merges, text)


def test_decoder_takes_bytes_as_they_come(tmp_path):
    """A byte-level vocabulary: characters split over ids, and bytes that are none."""
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library, decoder = Tokenizer.from_file(path), bpe_stream.Decoder(path)
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    single = [vocab[s] for s in bpe_stream.byte_symbols()]
    rng = random.Random(2)
    for _ in range(300):
        data = rng.choices(list("aé日\U0001f600".encode()), k=12) if rng.random() < 0.5 else list("aé日\U0001f600".encode())
        ids = [single[b] for b in data]
        parts = [decoder.feed([i]) for i in ids]
        assert "".join(parts) + decoder.finish() == library.decode(ids, skip_special_tokens=False)
        assert decoder.text(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


# fill-in-middle


def plain_fim(doc, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_fim_documents(spark, documents, nothing):
    marked = ["x <P> y", "<S>", "a<M", "<P", ">", "<<S>>", "日<本>語<", "é" * 9000, "ab\n" * 5000]
    rows = documents + [(5000 + i, t, None, None, None) for i, t in enumerate(marked)]
    df = fim.fill_in_middle(frame(spark, rows))
    df = df.withColumn("restored", fim.restore(df.form, df.output))
    found = df.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter(
        (r[0], *plain_fim(r[0], r[1])) for r in rows
    )
    assert Counter((r.doc_id, r.restored) for r in found) == Counter((r[0], r[1] or "") for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(nothing).count() == 0


def test_fim_cuts_and_sentinels_at_chunk_borders(monkeypatch):
    """Chunks of a few bytes: borders inside characters and sentinels, and a cache that overflows."""
    monkeypatch.setattr(fim, "CHUNK_BITS", 1)
    monkeypatch.setattr(fim, "CACHE_CHUNKS", 50)
    rng, cache = random.Random(1), {}
    for i in range(8000):
        text = "".join(rng.choices("<PSM>aé日\U0001f600", k=rng.randint(0, 14)))
        *numbers, output = fim.transform(i, text.encode(), cache)
        assert (*numbers, output.decode()) == plain_fim(i, text), text
    assert len(cache) <= 50


def test_chunks_follow_the_content():
    passage = prose(3, 3000).encode()
    one, other = fim.Chunks(passage, {}), fim.Chunks(b"something else before " + passage, {})
    pieces = [{c.data[a:b] for a, b in zip([0, *c.ends], c.ends, strict=False)} for c in (one, other)]
    assert len(pieces[0] & pieces[1]) >= len(pieces[0]) - 2 > 10
    assert max(b - a for a, b in zip([0, *one.ends], one.ends, strict=False)) <= fim.LONGEST
    ends = fim.chunk_ends(b"a" * 50_000)
    assert all(b - a <= fim.LONGEST for a, b in zip([0, *ends], ends, strict=False))


# periodic runs


def brute_runs(words, least=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q):
                s = words[i : i + size]
                if not any(all(s[k] == s[k + r] for k in range(size - r)) for r in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng, found = random.Random(3), 0
    for _ in range(1500):
        words, n, k = [], rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5])
        while len(words) < n:
            if rng.random() < 0.4:
                base = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
                words += (base * 40)[: rng.randint(len(base), 6 * len(base) + 20)]
            else:
                words += [rng.randrange(k + 1) for _ in range(rng.randint(1, 8))]
            if rng.random() < 0.3:
                words += words[-rng.randint(1, len(words)) :]
        words = words[:n]
        want = brute_runs(words)
        found += len(want)
        assert periodic.runs_of(np.array(words, dtype=int)) == want, words
    assert found > 500


def test_runs_with_other_bounds():
    rng = random.Random(4)
    for least, exponent in ((1, 3), (10, 4), (7, 3)):
        for _ in range(200):
            words = [rng.randrange(2) for _ in range(rng.randint(0, 60))]
            want = brute_runs(words, least, exponent)
            assert periodic.runs_of(np.array(words, dtype=int), least, exponent) == want


@pytest.mark.parametrize("shape", ["one word", "fibonacci", "long period", "two blocks"])
def test_runs_of_very_long_texts(shape):
    x, y = [0], [0, 1]
    while len(y) < 100_000:
        x, y = y, y + x
    words = {
        "one word": [0] * 100_000,
        "fibonacci": y[:100_000],
        "long period": list(range(5000)) * 20,
        "two blocks": [0] * 50_000 + [1] * 50_000,
    }[shape]
    start = time.time()
    runs = periodic.runs_of(np.array(words))
    assert time.time() - start < 30
    if shape == "fibonacci":
        assert len(runs) > 5000 and all(n >= max(24, 3 * q) for _, n, q in runs)
    else:
        want = {"one word": [(0, 100_000, 1)], "long period": [(0, 100_000, 5000)]}
        assert runs == want.get(shape, [(0, 50_000, 1), (50_000, 50_000, 1)])


def test_runs_of_documents(spark, docs, documents, nothing):
    want = Counter()
    for doc, text, *_ in documents:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        numbers = {w: i for i, w in enumerate(words)}
        seq = [numbers[w] for w in words]
        # brute force is quadratic: the long text has no repeated window, by construction
        runs = brute_runs(seq) if len(seq) < 5000 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[doc, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    found = Counter(
        (r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed)
        for r in periodic.find_runs(docs).collect()
    )
    assert found == want and any(k[2] for k in want)
    assert periodic.find_runs(nothing).count() == 0 and periodic.with_planted_periods(nothing).count() == 0


def test_planted_periods_and_digests(spark, sf_small):
    """The registered query against plain Python, planted texts included."""
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_small).collect()}
    planted = 0
    for d in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        numbers = {w: i for i, w in enumerate(words)}
        seq = [numbers[w] for w in words]
        runs = brute_runs(seq) if n < 3000 else periodic.runs_of(np.array(seq))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = found[d.doc_id]
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5
