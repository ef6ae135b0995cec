"""The operators on documents against plain versions of themselves, over every awkward kind of row."""

import binascii
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, lm_scoring, media, mixing, near_dedup, packing, substring_dedup, toxicity

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key long, h long, label string, size long, x double, t long, n int"


def _random(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def _awkward():
    """Texts: null, empty, blank, short, equal, near, long, with passages in common, in lines."""
    base = _random(1, 120)
    near = base.split()
    near[50] = "changed"
    passage = _random(2, 60)
    rows = [None, "", " \t\n\x0b\x0c\r ", "one", "One TWO three", "one two three", base, base.upper(), " ".join(near), base + " tail", "é " * 40 + base[:50]]
    rows += [_random(10 + i, 30) + " " + passage + " " + _random(40 + i, 30) for i in range(4)]
    rows += ["\n".join(_random(60 + i + k, 9) for k in range(6)) for i in range(3)] + [_random(5, 9) + "\n" + _random(60, 9) + "\n\n" + _random(61, 9) + "\r\nx"]
    rows += [_random(99, 6000), "x" * 50_000, _random(7, 40) + " " + _random(7, 40), "a b c d", "😀 " * 37]
    return rows


@pytest.fixture(scope="module")
def texts():
    out = [(i * 3 + 1, t) for i, t in enumerate(_awkward())]
    return [*out, (1000, "repeated row with some more words than five"), (1000, "repeated row with some more words than five")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en", [None, "a", "b", "src"][k % 4], 0, 0.5, "clash", 7, 8, "l", 9, 1.5, 3, 4) for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = {}
    for d, t in texts:
        w = _words(_lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert any(not r.kept for r in got)


def test_near_duplicates_links_chains_across_a_group(spark):
    """Many edits of one text, of which most pairs are below the threshold: components must be those of all pairs."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = f"e{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    label = list(range(120))
    for a in range(120):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {v: min(i for i in range(120) if label[i] == v) for v in set(label)}
    assert got == {d: first[label[d]] for d in range(120)}


def test_null_ids_and_filtering(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, None, True), (5, 2, False), (2, 2, True)}
    assert sorted(str(r.doc_id) for r in near_dedup.without_near_duplicates(df).collect()) == ["2", "None", "None"]


def test_substrings_equal_brute_force(docs, texts):
    places = collections.Counter()
    for _, t in texts:
        w = _words(t)
        places.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for d, t in texts:
        w = _words(t)
        gone = set()
        for i in range(len(w) - 34):
            if places[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in substring_dedup.without_repeats(docs, digest=True).collect())
    assert got == want
    assert sum(r[2] > 0 for r in want) >= 5


def test_equal_full_windows_are_stood_for_by_equal_windows():
    rng = np.random.default_rng(3)
    assert substring_dedup.lengths(35) == [9, 18, 35]
    assert substring_dedup.lengths(2) == [1, 2]
    for window in (2, 3, 23, 35, 100):
        passage = rng.integers(1, 1 << 62, window).astype(np.uint64)
        text = [rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (40, 7, 60)]
        levels = substring_dedup.Levels(np.concatenate([text[0], passage, text[1], passage, text[2]]), window)
        for level, length in enumerate(levels.lengths):
            at = levels.places(level)[[40, 47 + window]]
            h = levels.hashes(level)[at]
            assert h[0] == h[1]
            # the window lies within the full window
            assert all(q <= p <= q + window - length for p, q in zip(at, (40, 47 + window), strict=True)), (window, level)


@pytest.mark.parametrize("window", [2, 3, 8])
def test_substrings_of_other_lengths(spark, window):
    r = random.Random(window)
    rows = [(d, " ".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for d in range(12)]
    count = collections.Counter(tuple(t.split()[i : i + window]) for _, t in rows for i in range(len(t.split()) - window + 1))
    got = {x.doc_id: x for x in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    for d, t in rows:
        w, gone = t.split(), set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        assert got[d].kept == " ".join(x for i, x in enumerate(w) if i not in gone)


def _line_runs(rows):
    """Lines removed, by looking at every run of 1, 2 and 4 lines in order."""
    seqs = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        seqs[d] = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n"))]
        seqs[d] = [(i, x) for i, x in seqs[d] if x]
    gone = collections.defaultdict(set)
    for h in (1, 2, 4):
        seen = set()
        for d in sorted(seqs):
            s = seqs[d]
            for n in range(len(s) - h + 1):
                run = tuple(x for _, x in s[n : n + h])
                if run in seen and sum(len(_words(x)) for x in run) >= 8:
                    gone[d].update(i for i, _ in s[n : n + h])
                seen.add(run)
    return seqs, gone


def test_lines_equal_brute_force(docs, texts):
    seqs, gone = _line_runs(texts)
    got = line_dedup.without_repeated_runs(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        lines = (r.text or "").split("\n")
        kept = None if r.text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id])
        assert (r.n_lines, r.n_removed, r.kept) == (len(seqs[r.doc_id]), len(gone[r.doc_id]), kept)
    assert sum(len(g) for g in gone.values()) > 3
    assert set(line_dedup.deduplicated(docs).columns) == set(docs.columns)


def test_short_common_lines_stay_unless_in_a_run(spark):
    rows = [(1, "Yes.\nNo way.\n" + _random(1, 5)), (2, "Yes.\nother"), (3, "No way.\n" + _random(1, 5) + "\nend " + _random(3, 9))]
    got = {r.doc_id: r.kept for r in line_dedup.without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=7).collect()}
    assert got[1] == rows[0][1] and got[2] == "Yes.\nother" and got[3] == "end " + _random(3, 9)


def _any_run(rows, min_words=8):
    """Lines removed, by looking at every run of every length in order."""
    seqs = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in sorted(rows)}
    gone = collections.defaultdict(set)
    for h in range(1, max(map(len, seqs.values())) + 1):
        seen = set()
        for d, s in seqs.items():
            for n in range(len(s) - h + 1):
                run = tuple(x for _, x in s[n : n + h])
                if run in seen and sum(len(_words(x)) for x in run) >= min_words:
                    gone[d].update(i for i, _ in s[n : n + h])
                seen.add(run)
    return gone


def test_runs_of_any_number_of_lines(spark):
    """Runs of which no 1, 2 or 4 lines have the words: a word a line, 3 lines of 3 words, one pattern again and again."""
    r = random.Random(8)
    verse, three = "\n".join(WORDS[:40]), "\n".join(_random(20 + i, 3) for i in range(3))
    rows = [(1, "top\n" + verse), (2, verse + "\n\nend"), (3, three + "\nx"), (4, "y\n" + three), (5, "Un.\nAn ele.\n" * 20), (6, "\n".join(WORDS[50:57])), (7, "\n".join(WORDS[50:57]))]
    rows += [(10 + d, "\n".join(" ".join(r.choice("abc") for _ in range(r.choice((1, 1, 2, 3, 5)))) for _ in range(30))) for d in range(25)]
    gone = _any_run(rows)
    assert len(gone[2]) == 40 and len(gone[4]) == 3 and len(gone[5]) == 38 and not gone[7]
    for got in line_dedup.without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert got.n_removed == len(gone[got.doc_id]), got.doc_id
        assert got.kept == "\n".join(x for i, x in enumerate(got.text.split("\n")) if i not in gone[got.doc_id])


def test_mixing_meets_its_targets(spark):
    r = random.Random(0)
    rows = [(d, " ".join(["w"] * r.randint(0, 60)), r.choice(["s1", "s2", "s2", "s2", None, "Z"])) for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(5)).collect()
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(2)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source])
        assert 0 <= x.taken <= 2 * x.size and (x.size or not x.taken)
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
        assert sum(x.part > 0 for x in got if x.source == s) <= 1


def test_mixing_is_fair(spark):
    """Over many seeds each document is taken as often as its share says."""
    rows = [(d, " ".join(["w"] * (1 + d % 7)), "a" if d < 40 else "b") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n, sums, given = 12, collections.Counter(), {}
    for seed in range(n):
        for x in mixing.mix(df, seed=seed).collect():
            sums[x.source] += x.taken / x.size
            given[x.source] = x.target / x.source_size
    for s, k in (("a", 40), ("b", 20)):
        assert sums[s] / (n * k) == pytest.approx(given[s], abs=0.08)


def test_mixing_awkward_rows(docs, texts, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(empty).count() == 0
    assert mixing.materialise(docs).columns == docs.columns


def test_materialised_rows_that_share_an_id_keep_their_own_copies(spark):
    rows = [(None if d % 2 else 7, f"w{d % 50} " + "w " * (d % 9), f"s{d % 3}") for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    due, got = collections.Counter(), collections.Counter()
    for x in mixing.mix(df).collect():
        due[x.doc_id, x.source, x.size] += x.copies + (2 * x.part >= max(x.size, 1))
    for x in mixing.materialise(df).collect():
        got[x.doc_id, x.source, len(x.text.split())] += 1
    assert got == +due


def test_packing_holds_every_id_once(docs, texts, empty):
    from tidemark.llm.tokens import word_tokenizer

    t = word_tokenizer(packing.TOKENIZER).tokenizer
    want = collections.Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in texts)
    pieces = packing.pack(docs, with_ids=True).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == binascii.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
        by[p.sequence_id].append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert len(own) <= 64 and (at == 4096 or at & (at - 1) == 0)
    docs_ = collections.defaultdict(list)
    for p in pieces:
        docs_[p.doc_id].append(p)
    for d, own in docs_.items():
        expected = [x for (k, x), n in want.items() if k == d for _ in range(n)]
        assert sum(p.length for p in own) == sum(map(len, expected))
        if len(expected) == 1:
            own.sort(key=lambda p: p.start)
            assert tuple(i for p in own for i in p.ids) == expected[0] and all(p.doc_tokens == len(expected[0]) for p in own)
    assert packing.pack(empty).count() == 0


def test_packer_keeps_every_limit():
    import numpy as np

    r, p, total = random.Random(1), packing.Packer(64, 5, 40, waiting=16), 0
    for k in range(500):
        n = r.randint(1, 90)
        total += n
        p.add(k, np.arange(n, dtype=np.int32), k % 3 > 0)
    p.finish()
    placed = p.take(True)
    tokens, segments, loss, pieces = (collections.Counter() for _ in range(4))
    for key, start, ids, sequence, _ in placed:
        assert ids[0] == start
        tokens[sequence] += len(ids)
        segments[sequence] += 1
        loss[sequence] += len(ids) * (key % 3 > 0)
        pieces[key] += len(ids)
    assert max(tokens.values()) <= 64 and max(segments.values()) <= 5 and max(loss.values()) <= 40 and sum(tokens.values()) == total


def test_media_round_trip(docs, texts, empty):
    got = media.store_texts(docs).collect()
    assert len(got) == len(texts)
    want = collections.Counter()
    for d, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all("octet-stream>audio/wav" in r.feature and r.media_bytes == r.payload_bytes + 44 for r in got)
    assert media.store_texts(empty).count() == 0


def test_sniffing(spark):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav = media.to_wav(b"abc" * 5 + b"d")
    rows = [(1, png, "image/gif", "clash"), (2, b"xx" + png + b"--" + wav, "audio/wav", "clash"), (3, png[:-3], "image/png", None), (4, b"", None, None), (5, None, "a/b", None), (6, b"RIFF1234WAVE", "audio/wav", None)]
    out = {r.id: r for r in media.sniff_media(spark.createDataFrame(rows, "id int, content binary, declared string, media_type string"), "content", "declared").collect()}
    assert (out[1].media_type, out[1].media_length, out[1].mislabelled) == ("image/png", len(png), True)
    assert [(c.type, c.offset, c.length) for c in out[2].carved] == [("image/png", 2, len(png)), ("audio/wav", 4 + len(png), len(wav))]
    assert out[3].media_type == media.UNKNOWN and out[4].media_type == media.UNKNOWN and out[4].mislabelled is None
    assert out[5].media_type is None and out[5].carved == [] and out[6].media_type == media.UNKNOWN


def test_lm_base_and_model(docs, texts, empty):
    import zlib

    got = lm_scoring.score_texts(docs).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter()
    for d, t in texts:
        if not held(d):
            c.update(_words(_lower(t)))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for d, t in texts:
        w = [*_words(_lower(t)), "\n"]
        want[d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_texts(empty).count() == 0


def test_lm_weights_are_fitted_to_every_training_text_once(spark, tmp_path, monkeypatch):
    """Texts given to the trainer leave a file each; null ids aren't dealt as they aren't of the fold."""
    rows = [(d, f"text {d} " + _random(d, 5)) for d in range(200)] + [(None, "no id")]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "SHARD", 100)  # several shards a round
    real = lm_scoring._trained

    def noting(tokenizer, sent):
        train = real(tokenizer, sent)

        def run(rows):
            for text in rows["text"]:
                with open(f"{tmp_path}/{text.split()[1]}", "a") as f:
                    f.write("x")
            return train(rows)

        return run

    monkeypatch.setattr(lm_scoring, "_trained", noting)
    lm_scoring.learn(df, F.col("doc_id") % 7 != 2, lm_scoring.Stage(spark, "lm-test"))
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == {str(d): "x" for d in range(200) if d % 7 != 2}


def test_lm_scores_equal_a_plain_version_and_do_not_depend_on_partitions(spark, monkeypatch):
    """The query's scores against a plain loop over positions: softmax, class shares, word ends, and the memory of words."""
    import numpy as np

    monkeypatch.setattr(lm_scoring, "SHARD", 500)
    rows = [(d, _random(d, 5 + d % 40, WORDS[:60]) + (f" rare{d}, Word." if d % 3 else "")) for d in range(120)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(df.repartition(2)).collect()}
    again = {r.doc_id: r.score for r in lm_scoring.score_texts(df.repartition(5)).collect()}
    assert got == pytest.approx(again, rel=1e-9)
    learnt = lm_scoring.learn(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, lm_scoring.Stage(spark, "lm-test"))
    p, v, t = learnt.parameters, learnt.vocabulary, lm_scoring.subwords(lm_scoring.TOKENIZER)
    words = collections.Counter()
    for d, text in rows:
        if binascii.crc32(str(d).encode()) % 7 != 2:
            words.update([*_words(_lower(text)), "\n"])
    total, memory = sum(words.values()), 1 - sum(n == 1 for n in words.values()) / sum(words.values())
    for d, text in rows[::9] + rows[-2:]:
        ids = t(text)
        before, real, after, wanted = lm_scoring.windows_of(ids)
        logits = lm_scoring._forward(p, v, before, real)["logits"].astype(float)[wanted]
        prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        own = [prob[k, v.of[i]] * 10.0 ** v.share[i] for k, i in enumerate(after[wanted])]
        begin = prob @ v.begins
        whole, at = 0.0, 0
        for w in [*_words(_lower(text)), "\n"]:
            n = len(t(w)) if w != "\n" else 1
            spelt = np.prod(own[at : at + n]) / begin[at] * (begin[at + n] if w != "\n" else 1)
            whole += math.log10(memory * words[w] / total + (1 - memory) * spelt)
            at += n
        assert at == len(own) and got[d] == pytest.approx(whole, rel=1e-3)


def test_lm_is_a_distribution_and_learns():
    import numpy as np

    t = lm_scoring.subwords(lm_scoring.TOKENIZER)
    r = random.Random(0)
    texts = [t(" ".join(r.choice(["the cat sat", "a dog ran", "on the mat"]) for _ in range(20))) for _ in range(60)]
    counts = np.bincount(np.concatenate([np.append(x, lm_scoring.END) for x in texts]), minlength=t.size)
    v = lm_scoring.Vocabulary.build(counts, t.first)
    assert np.allclose(np.bincount(v.of, 10.0**v.share, lm_scoring.ALONE + lm_scoring.MANY)[np.unique(v.of)], 1, atol=1e-4)
    trainer = lm_scoring.Trainer(lm_scoring.initial(), v)
    before = lm_scoring.log10_probabilities(trainer.p, v, texts[:5]).sum()
    for _ in range(6):
        lm_scoring._steps(trainer, [lm_scoring.windows_of(x) for x in texts])
    after = lm_scoring.log10_probabilities(trainer.p, v, texts[:5])
    assert after.sum() > before / 2
    # each id is scored once, and what comes later changes nothing before
    ids, _, targets, wanted = lm_scoring.windows_of(texts[0])
    assert targets[wanted].tolist() == [*texts[0].tolist(), lm_scoring.END] and ids.shape[1] == lm_scoring.OLD + lm_scoring.NEW
    f = lm_scoring._forward(trainer.p, v, *lm_scoring.windows_of(texts[0])[:2])["logits"]
    changed = texts[0].copy()
    changed[-1] = 5
    g = lm_scoring._forward(trainer.p, v, *lm_scoring.windows_of(changed)[:2])["logits"]
    last = (len(texts[0]) - 1) // lm_scoring.NEW
    assert np.allclose(f[: last - 1], g[: last - 1])


def test_lm_tells_each_new_word_once_and_words_of_other_white_space(spark):
    """The tokenizer is asked for words, not for texts: copies cost no more, and no id reaches over two words."""
    t = lm_scoring.Subwords()
    real, told = t.encoding, []

    class Noting:
        def encode_to_numpy(self, text, **named):
            told.extend(text.split(" ")[1:])
            return real.encode_to_numpy(text, **named)

    t.encoding = Noting()
    texts = ["The cat's 12 dogs, the CAT"] * 50 + ["the cow", "", None]
    got = t.texts(lm_scoring.Words(texts, lower=True))
    assert sorted(told) == ["12", "cat", "cat's", "cow", "dogs,", "the"]
    assert [x.tolist() for x in got] == [real.encode((" " + _lower(x)) if x else "") for x in texts]
    odd = "x \u00a0 \u00a0 y \u3000\u2003 z\x85 \x1c"
    assert t.first[t(odd)].sum() == 7
    rows = [(1, odd), (2, "x y"), (3, "\u00a0 \u00a0"), (4, None)]
    out = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {1: 8, 2: 3, 3: 3, 4: 1} and all(math.isfinite(r.score) for r in out)


def test_lm_keeps_words_met_again_when_others_are_let_go(monkeypatch):
    """Beyond the limit, words met once are told again when they come back, words met again are not; ids stay right."""
    monkeypatch.setattr(lm_scoring, "KEPT_WORDS", 6)
    t = lm_scoring.Subwords()
    real, told = t.encoding, []

    class Noting:
        def encode_to_numpy(self, text, **named):
            told.extend(text.split(" ")[1:])
            return real.encode_to_numpy(text, **named)

    t.encoding = Noting()
    texts = ["the cat", "the cat unlikeliest", "dogs barking at geese", "the cat geese", "", "a1 b2 c3 d4 e5 f6 g7 h8", "the cat a1"]
    for x in texts:
        got = t.texts(lm_scoring.Words([x], lower=True))
        assert [g.tolist() for g in got] == [real.encode(" " + x) if x else []]
    assert told.count("the") == told.count("cat") == 1 and told.count("geese") == 2


def test_lm_scores_beyond_float32s_exp_are_those_of_the_plain_model():
    import numpy as np

    t = lm_scoring.subwords(lm_scoring.TOKENIZER)
    texts = [t(" ".join(WORDS[:n])) for n in (0, 3, 40)]
    counts = np.bincount(np.concatenate(texts), minlength=t.size)
    v = lm_scoring.Vocabulary.build(counts, t.first)
    for large in ({"out": 300, "last": 50}, {"query": 900, "key": 40}, {"bias": -500}):
        p = {k: x * large.get(k, 1) + (large["bias"] if k == "bias" and k in large else 0) for k, x in lm_scoring.initial().items()}
        p = {k: x.astype(np.float32) for k, x in p.items()}
        ids, real, after, wanted = (np.concatenate(x) for x in zip(*map(lm_scoring.windows_of, texts)))
        logits = lm_scoring._forward(p, v, ids, real)["logits"][wanted].astype(float)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        want = np.maximum(logits[np.arange(len(logits)), v.of[after[wanted]]], -80)
        got = lm_scoring.Scorer(p, v).places(texts)[1] - v.share[after[wanted]]
        assert np.allclose(np.maximum(got / lm_scoring.LOG10, -80), want, rtol=1e-3, atol=2e-2), large
        assert lm_scoring.Trainer(p, v)._gradients(ids, real, after, wanted) == pytest.approx(-np.maximum(want, math.log(1e-30)).mean(), rel=1e-3)


def test_lm_gradients_are_those_of_the_plain_model():
    """Differences of the loss of ``_forward`` along random directions, one for each weight array; some positions are not wanted, some not there."""
    import numpy as np

    rng = np.random.default_rng(3)
    size = lm_scoring.END + 1
    v = lm_scoring.Vocabulary.build((1e6 / (1 + np.arange(size))).astype(np.int64), np.arange(size) % 3 == 0)
    p = {k: x.astype(float) + 0.1 * rng.standard_normal(x.shape) for k, x in lm_scoring.initial().items()}
    texts = [(rng.random(n) ** 4 * (size - 1)).astype(np.int32) for n in (0, 3, 24, 200, 900)]
    ids, real, targets, wanted = (np.concatenate(x) for x in zip(*map(lm_scoring.windows_of, texts)))

    def loss(q):
        logits = lm_scoring._forward(q, v, ids, real)["logits"][wanted]
        logits = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return -logits[np.arange(len(logits)), v.of[targets[wanted]]].mean()

    trainer = lm_scoring.Trainer(p, v)
    assert trainer._gradients(ids, real, targets, wanted) == pytest.approx(loss(p), rel=1e-5)
    for k, x in p.items():
        way = rng.standard_normal(x.shape)
        found = (loss(p | {k: x + 1e-3 * way}) - loss(p | {k: x - 1e-3 * way})) / 2e-3
        assert (trainer.grad[k] * way).sum() == pytest.approx(found, rel=2e-2, abs=2e-4), k


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(3)
    rows, labels = [], []
    for d in range(500):
        bad = d % 4 == 0
        w = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["horrid", "Horridly", "vilest"]))
        rows.append((d, " ".join(w), "x"))
        labels.append((d, 1, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score(df, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    right = sum(x.predicted == int(x.doc_id % 4 == 0) for x in out)
    assert right / len(out) > 0.95 and all(0 <= x.score <= 1 for x in out)


def test_toxicity_awkward_rows(spark, docs, texts, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    out = toxicity.score(docs, model)
    assert out.count() == len(texts) and set(out.columns) == {*docs.columns, "predicted"}
    assert out.where("score is null").count() == 0
    some = spark.createDataFrame([(1, None, 1), (4, 1, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.train(docs, some)).count() == 0


@pytest.mark.parametrize("name", ["near", "substrings", "lines"])
def test_empty_tables(empty, name):
    run = {"near": near_dedup.near_duplicates, "substrings": substring_dedup.without_repeats, "lines": line_dedup.without_repeated_runs}[name]
    assert run(empty).count() == 0
