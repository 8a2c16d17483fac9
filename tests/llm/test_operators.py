"""The dealt operators against brute force, on small tables."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlens.llm import bpe, common, components, decontaminate, exact_dedup, language, line_dedup, sharding, simhash, substring_dedup, token_counts, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(x):
    return hashlib.sha256(x).hexdigest()


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20


def test_trimmed_gives_memory_back():
    held = []

    def run(batches):
        for batch in batches:
            parts = [b"x" * 3000 + bytes([i % 256]) for i in range(60_000)]
            held.append(parts[-1])  # the last of the heap stays
            yield batch

    before = resident()
    assert list(common.trimmed(run)([1])) == [1]
    assert resident() - before < 90


# ---- 1: exact dedup -------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak, monkeypatch):
    # Of three or more copies some are hot.
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 2)
    digest = F.expr("cast(cast(length(coalesce(text, '')) % 5 as string) as binary)") if weak else None
    got = exact_dedup.classes(docs, digest=digest).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    want = Counter((-1 if i is None else i, max(groups[t or ""]), len(groups[t or ""]), sha((t or "").encode())) for i, t, *_ in rows)
    assert Counter((-1 if r.place.id is None else r.place.id, -1 if r.keep.id is None else r.keep.id, r.n, r.sha256) for r in got) == want
    assert sum(r.place == r.keep for r in got) == len(groups)


def test_exact_dedup_starts_few_processes(spark, docs, tmp_path):
    # A process that an executor starts shares its memory for a moment; the state asked for about 20 for each partition.
    flight = spark._jvm.jdk.jfr.Recording()
    flight.enable("jdk.ProcessStart")
    flight.start()
    exact_dedup.classes(docs).collect()
    flight.stop()
    dump = spark._jvm.java.io.File(str(tmp_path / "processes.jfr")).toPath()
    flight.dump(dump)
    flight.close()
    commands = [e.getString("command") for e in spark._jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(dump)]
    assert not [c for c in commands if c.startswith("readlink")]
    assert len([c for c in commands if ".changelog." in c]) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_exact_dedup_keeps_columns(docs, rows, empty):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[1] or "" for r in rows})
    assert exact_dedup.report(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_exact_dedup_state_goes_on(spark, tmp_path):
    path = str(tmp_path / "keys")
    frame = lambda ids: spark.createDataFrame([(bytes([i % 3]), (i, "f", i)) for i in ids], "digest binary, place struct<id:bigint,file:string,row:bigint>")
    frame(range(6)).write.parquet(path)
    exact_dedup.fold(spark.read.parquet(path), str(tmp_path / "state"))
    frame(range(6, 10)).write.mode("append").parquet(path)
    got = exact_dedup.fold(spark.read.parquet(path), str(tmp_path / "state"))
    assert {bytes(r.digest)[0]: (r.keep.id, r.n) for r in got.collect()} == {0: (9, 4), 1: (7, 3), 2: (8, 3)}


# ---- 2: byte-level BPE ----------------------------------------------------------------------


def codec():
    with open(RANKS, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


def test_bpe(docs, rows, empty):
    c = codec()
    got = Counter(map(tuple, bpe.report(docs, RANKS, public_tokenizers.PATTERN).collect()))
    want = Counter()
    for i, t, *_ in rows:
        ids = c.encoding.encode_ordinary(t or "")
        want[(i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode()))] += 1
    assert got == want
    out = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    # docs has a column token_ids; it stays.
    assert out.columns == [*docs.columns, "token_ids_"] and {r.token_ids for r in out.collect()} == {r[9] for r in rows}
    back = bpe.decoded(out, RANKS, public_tokenizers.PATTERN, "token_ids_", "text")
    assert back.columns == [*docs.columns, "token_ids_", "text_"] and all(bytes(r.text_) == (r.text or "").encode() for r in back.collect())
    assert bpe.report(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_joins_anywhere():
    """Whatever the leaves' size, the ids are the library's, and decoding gives the text back."""
    rng = random.Random(1)
    c = codec()
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'ll", "7", "42", "!", "...", "日本", " ", " ", "🙂", "_", "\x1f", "\u0085"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 160)))
        ids = c.encoding.encode_ordinary(text)
        for leaf in (2, 3, 7, 31):
            assert c.encode(text, leaf) == ids, (text, leaf)
        assert c.decode(ids, 4) == text.encode() and bpe.unpack(bpe.pack(ids)) == ids
    long = "x" * 5000 + " " + "é" * 999 + "\n" * 40 + "y z " * 500
    assert c.encode(long, 64) == c.encoding.encode_ordinary(long)


# ---- 3: sharding ----------------------------------------------------------------------------


def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.filled(names, 1009)
    share = Counter(table)
    assert set(share) == set(names) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.filled(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s6")
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.filled(bad)
    with pytest.raises(ValueError):
        sharding.filled(["a"], 1000)


def brute_fill(names, slots):
    """The turns, played naively with whole preference lists."""
    names = sorted(names)
    orders = []
    for s in names:
        at, step = xxhash.xxh64_intdigest(s, 1) % slots, xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1
        orders.append([(at + j * step) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for s, order in zip(names, orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = s
    return [owner[x] for x in range(slots)]


def test_sharding(docs, rows, empty, spark, tmp_path):
    assert sharding.filled(["a", "b", "c"], 101) == brute_fill(["a", "b", "c"], 101)
    names = [f"s{i}" for i in range(5)]
    table = sharding.filled(names, 1009)
    got = sharding.placed(docs, "doc_id", names, 1009)
    for r in got.select("doc_id", "slot", "shard").collect():
        slot = int(np.int64(np.uint64(xxhash.xxh64_intdigest("" if r.doc_id is None else str(r.doc_id), 42)))) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    assert got.count() == len(rows) and sharding.report(empty).count() == 0
    sharding.write(docs, "doc_id", names, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_sharding_keeps_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "s"), (None, "y", "t"), (1, "x" * 100_000, "s")], "doc_id bigint, shard string, Slot string")
    got = sharding.placed(df, "doc_id", ["a", "b"], 101)
    assert got.columns == ["doc_id", "shard", "Slot", "slot_", "shard_"] and sorted(r.shard[0] for r in got.collect()) == ["x", "x", "y"]
    assert len({r.shard_ for r in got.where("doc_id = 1").collect()}) == 1
    sharding.write(df, "doc_id", ["a", "b"], str(tmp_path / "out"), 2)
    assert set(spark.read.parquet(str(tmp_path / "out")).columns) == {*df.columns, "shard_"}


# ---- 4: token counts ------------------------------------------------------------------------


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = Counter(map(tuple, token_counts.report(docs, VOCABULARY).collect()))
    want = Counter()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want and token_counts.report(empty, VOCABULARY).count() == 0


def test_token_counts_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "LIMIT", 5)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, "rb") as f:
        c = token_counts.PieceCounter(f.read())
    rng = random.Random(5)
    alphabet = ["a", "Zé", " ", "\n", " ", "²", "½", "'re", "'", "<|endoftext|>", "日", "́", " ", "ǅ", "…", "\x1c", "\x85", "·", "9"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert c.count(text) == len(tokenizer.encode(text, add_special_tokens=False)), repr(text)


# ---- 5: line dedup --------------------------------------------------------------------------


def test_line_dedup(spark):
    page = lambda body: f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body>{body}</body></html>"
    rows = [(i, f"http://Big.example.com/{i}", page(f"<p>menu</p><p>own {i}</p><p> menu </p><div>half{i % 2}</div>"), "h") for i in range(10)]
    rows += [(20, "http://small.org/1", page("<p>menu</p>"), "h"), (21, "http://small.org/2", page("<p>menu</p>"), "h")]
    rows += [(30, None, None, "h"), (31, "no url", "", "h"), (32, None, page("<b>in</b>line<br>next"), "h")]
    got = {r.page_id: r for r in line_dedup.cleaned(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string"), 0.6, 5).collect()}
    assert len(got) == len(rows)
    for i in range(10):
        # The title and the menu stand on all ten pages; half of the pages is no more than the ratio.
        assert got[i].host == "big.example.com" and got[i].text == f"own {i}\nhalf{i % 2}" and (got[i].n_lines, got[i].n_dropped) == (5, 3)
    assert got[20].text == "t\nmenu" and got[30].n_lines == 0 and got[31].text == "" and got[32].text == "t\ninline\nnext"
    assert line_dedup.report(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_line_dedup_awkward_rows(spark, monkeypatch):
    """A very long page, repeated rows, a null id, hostile markup; dealt in parts of one host."""
    monkeypatch.setattr(line_dedup, "PART_ROWS", 3)
    long = "".join(f"<p>line {i}</p>" for i in range(20_000))
    rows = [(i, "http://h.example/", f"<p>menu</p><p>own {i}</p>", "dropped", 1) for i in range(7)]
    rows += [rows[0], rows[0], (None, "http://h.example/x", "<p>menu</p>", "d", 1), (8, "http://h.example/", "<p>menu</p>" + long, "d", 1), (9, "http://h.example/", "<p " * 3000, "d", 1)]
    got = line_dedup.cleaned(spark.createDataFrame(rows, "page_id bigint, url string, html string, dropped string, part int"), 0.5, 5)
    assert got.columns == ["page_id", "host", "n_lines", "n_dropped", "text"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append((r.n_lines, r.n_dropped, r.text))
    # "own 0" stands on three of twelve pages.
    assert by[0] == [(2, 1, "own 0")] * 3 and by[None] == [(1, 1, "")] and by[8][0][:2] == (20_001, 1) and len(got.collect()) == len(rows)


# ---- 6: url filters -------------------------------------------------------------------------


def test_url_filter(spark):
    urls = {
        "http://example.com/en/81": ("com/en/", "block", "example.com", "/en/81"),
        "https://A.Example.COM/en/7?x": ("example.com/en/7", "allow", "a.example.com", "/en/7"),
        "http://notexample.com/en/7": ("com/en/", "block", "notexample.com", "/en/7"),
        "http://x.net/de/9#f": ("net/de/", "allow", "x.net", "/de/9"),
        "http://example.net/de/80": ("example.net/de/8", "block", "example.net", "/de/80"),
        "ftp://a.org/es/": ("org/es/", "block", "a.org", "/es/"),
        "http://library.example.org": (None, "allow", "library.example.org", ""),
        "http://www.cheap-pills.example.org/x": (None, "block", "www.cheap-pills.example.org", "/x"),
        "com/en/": (None, None, "", ""),
        None: (None, None, "", ""),
    }
    rows = [(i, u, "r") for i, u in enumerate(urls)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, rule string")).collect()
    assert len(got) == len(urls)
    for r in got:
        rule, verdict, host, path = list(urls.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert verdict in (None, r.verdict) and (rule or 0 <= r.score <= 1)
    assert url_filter.judged(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def brute_rule(host, path):
    fit = [(h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_url_filter_rules_brute_force(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a.', '', 'xx'])}{rng.choice(['example.com', 'example.net', 'q.org', 'com'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['', '7', '8', '71', '800'])}" for _ in range(200)]
    for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect():
        rule, action = brute_rule(r.host, r.path)
        assert r.rule == rule and action in (None, r.verdict)


def held_out(rows, part):
    """The share of rows that a model of the other parts gets right."""
    right = 0
    for k in set(part):
        w = url_filter.fitted([r for r, t in zip(rows, part) if t != k])
        own = [r for r, t in zip(rows, part) if t == k]
        right += sum((p >= 0.5) == bool(y) for p, (*_, y) in zip(url_filter.probabilities(w, [r[0] for r in own], [r[1] for r in own]), own))
    return right / len(rows)


def test_url_model_on_held_out_rows():
    """By rows (the word of most is in the fit, by hash: every third row would be one ending for each label), and by whole words."""
    rows = url_filter.labelled()
    assert held_out(rows, [xxhash.xxh64_intdigest(h + p) % 3 for h, p, _ in rows]) > 0.9
    word = [next(w for w in url_filter.BAD + url_filter.GOOD if f"{w}.example." in h or p.startswith(f"/{w}/")) for h, p, _ in rows]
    assert held_out(rows, [xxhash.xxh64_intdigest(w, 3) % 5 for w in word]) > 0.78


def test_url_features_brute_force():
    """Each distinct n-gram of a marked host or path has one place, whatever stands beside it in the batch."""
    rng = random.Random(3)
    hosts = ["".join(rng.choice("ab.é") for _ in range(rng.randrange(9))) for _ in range(40)]
    paths = ["/" * (i % 2) + "".join(rng.choice("ab/") for _ in range(rng.randrange(9))) for i in range(40)]
    row, at = url_filter.features(hosts, paths)
    known = {}
    for i, (h, p) in enumerate(zip(hosts, paths)):
        grams = {(m, t[k : k + n]) for m, t in (("h", f"^{h}$"), ("p", f"^{p}$")) for n in (3, 4, 5) for k in range(len(t) - n + 1)}
        alone = set(url_filter.features([h], [p])[1].tolist())
        assert alone == set(at[row == i].tolist()) and len(alone) <= len(grams)
        for m, g in grams:
            known.setdefault((m, g), set()).add(i)
    # A gram's place is in all rows that have it.
    for who in known.values():
        assert set.intersection(*(set(at[row == i].tolist()) for i in who))
    assert len(set(at.tolist())) > 0.98 * len(known)


def test_url_filter_awkward_rows(spark):
    rows = [(1, "http://a.org/" + "é/x" * 40_000, "h", 1.0), (2, "http://a.org/es/1", "h", 1.0), (2, "http://a.org/es/1", "h", 1.0), (None, None, None, None), (3, "", None, None), (4, "http://", None, None)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, host string, score double"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    got = sorted(got.collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in got] == [1, 2, 2, 3, 4, None] and len(got[0].path) == 120_001
    assert all((r.score is None) == (r.rule is not None) and r.verdict in ("allow", "block") for r in got)
    assert got[1] == got[2] and [(r.host, r.path) for r in got[3:]] == [("", "")] * 3


# ---- 7: SimHash -----------------------------------------------------------------------------


def brute_print(text, k):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("radius", [2, 9])
def test_simhash_components(docs, rows, empty, radius):
    prints = [brute_print(t, 3) for _, t, *_ in rows]
    where = classes_of(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    least = {}
    for (i, *_), c in zip(rows, where):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or least.get(c) is not None else None
    want = Counter((i, f"{p:016x}", least[c]) for (i, *_), p, c in zip(rows, prints, where))
    got = Counter(map(tuple, simhash.components(docs, radius=radius).collect()))
    assert got == want
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 10_000])
def test_near_duplicates(docs, rows, empty, monkeypatch, tile):
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    monkeypatch.setattr(simhash, "BIT_TILE", tile)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, *_ in rows]
    where = classes_of(len(rows), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(where))
    assert simhash.one_of_each(empty).count() == 0


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for size, other in ((0, 3), (40, 40), (500, 530), (600, 560), (3000, 3600), (1024, 1025)):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size * 9 // 10], rng.integers(0, 1 << 63, other - size * 9 // 10).astype(np.uint64)]))
        x, y = simhash.parity(a), simhash.parity(b)
        while len(x) != len(y):
            x, y = (z if len(z) == min(len(x), len(y)) else z[: len(z) // 2] ^ z[len(z) // 2 :] for z in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_a_large_group_of_near_copies(spark, monkeypatch):
    # One list of a shingle fills many tiles; chains of copies, each near the next only, and texts that share no more than a passage.
    monkeypatch.setattr(simhash, "SET_TILE", 8)
    monkeypatch.setattr(simhash, "BIT_TILE", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(50)]
    for _ in range(60):
        chain = [*chain[2:], word(), word()]
        texts.append(" ".join(chain))
    for _ in range(90):
        texts.append(" ".join([*base[:12], *(word() for _ in range(rng.randrange(30, 60)))]))
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    where = classes_of(len(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(where))


def test_near_duplicates_at_the_limit(spark, monkeypatch):
    # Four shingles against the same and one more: Jaccard 0.8 exactly. And larger pairs beside a frequent passage.
    monkeypatch.setattr(simhash, "SET_TILE", 16)
    monkeypatch.setattr(simhash, "BIT_TILE", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    texts = []
    for _ in range(600):
        short = " ".join(word() for _ in range(8))
        texts += [short, f"{short} {word()}"]
    passage = " ".join(word() for _ in range(60))
    for n in (20, 28, 100):
        for _ in range(20):
            long = [word() for _ in range(n)]
            more = [word() for _ in range((n + 60 - 4) // 4)]
            texts += [" ".join([*long, passage]), " ".join([*long, passage, *more])]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, set()).add(i)
    near = {(a, b) for a, s in enumerate(sets) for b in set().union(*(by[h] for h in s)) if len(s & sets[b]) >= 0.8 * len(s | sets[b])}
    where = classes_of(len(sets), lambda a, b: (a, b) in near)
    assert len(set(where)) < len(texts) - 600
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(where))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.u: r.v for r in components.stars(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {301: 300}
    assert got == want


# ---- 8: substring dedup ---------------------------------------------------------------------


def brute_substring(rows):
    first = {}
    ws = [substring_dedup.words_of(t) for _, t, *_ in rows]
    order = [float("inf") if r[0] is None else r[0] for r in rows]
    for w, i in zip(ws, order):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for w, i, r in zip(ws, order, rows):
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[(r[0], len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone)))] += 1
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup.matched, "__defaults__", ("doc_id", "text", hot))
    got = Counter(tuple(r) for r in substring_dedup.report(docs).collect())
    assert got == brute_substring(rows)


def test_substring_dedup_empty(empty):
    assert substring_dedup.report(empty).count() == 0


def test_automaton():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 14))] for _ in range(4)]
        owners = [rng.randint(0, 9) for _ in texts]
        a = substring_dedup.Automaton()
        for t, o in zip(texts, owners):
            a.add(t, o)
        a.done()
        probe = [rng.choice("ab") for _ in range(12)]
        for n in (1, 3, 5):
            want = []
            for i in range(len(probe) - n + 1):
                own = [o for t, o in zip(texts, owners) if any(t[j : j + n] == probe[i : i + n] for j in range(len(t) - n + 1))]
                want.append(min(own, default=substring_dedup.LAST))
            assert a.owners(probe, n) == want


def test_substring_against_reference(docs, rows):
    some = docs.where("doc_id in (3, 66)")
    ref = {tuple(w[i : i + 13]) for r in rows if r[0] in (3, 66) for w in [substring_dedup.words_of(r[1])] for i in range(len(w) - 12)}
    want = Counter()
    for i, t, *_ in rows:
        w = substring_dedup.words_of(t)
        gone = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in ref for j in range(k, k + 13)}
        want[(i, len(w), len(gone))] += 1
    assert Counter(map(tuple, substring_dedup.against(docs, some).collect())) == want
    with pytest.raises(ValueError):
        substring_dedup.against(docs, some, limit=10)


# ---- 9: decontamination ---------------------------------------------------------------------


def best_edits(item, text):
    """Fewest edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [noise(rng.randint(60, 120)).strip() for _ in range(5)] + ["abc", "", None, "  The Exact   ITEM text that is   long enough for grams  "]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["#"], [t[k], "#"]])
        return "".join(t)

    texts = [noise(300) for _ in range(12)]
    texts += [noise(50) + edited(items[i % 5], n) + noise(50) for i, n in enumerate([0, 2, 4, 5, 6, 7, 9, 12, 20])]
    texts += [items[0] + items[1], items[2][5:], "x" + items[8].lower(), "", None, "  ABC ", noise(3000) + items[3]]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.found(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            a, b = decontaminate.collapsed(x), decontaminate.collapsed(t)
            if a and b:
                budget = min(int(0.1 * len(a)), max(len(a) - 8, 0) // 8)
                n = best_edits(a, b)
                if n <= budget:
                    want[(i, k)] = n
    assert set(got) == set(want) and all(want[k] <= got[k] for k in want)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.found(docs.where("false"), bench).count() == 0 and decontaminate.found(docs, bench.where("false")).count() == 0


def test_decontaminate_short_items(spark):
    rng = random.Random(9)
    sizes = [8, 9, 10, 12, 15, 16, 20, 23, 24, 30, 31, 32]
    items = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(m)) for m in sizes]
    texts = []
    for t in items:
        for n in (0, 1, 2, 3, 4):
            at = [(i + 1) * len(t) // (n + 1) for i in range(n)]
            texts.append("1234 " * 5 + "".join("#" if i in at else c for i, c in enumerate(t)) + " 5678" * 5)
            texts.append("90 " + "".join(c for i, c in enumerate(t) if i not in at) + " 21")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.found(docs, bench).collect()}
    want = {(i, k): n for i, t in enumerate(texts) for k, x in enumerate(items) if (n := best_edits(x, t)) <= len(x) // 10}
    assert got == want and any(n == 3 for n in got.values())
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontaminate_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    items = [f"item number {i} has a text of its own, {i * 7919} and more {i * 104729}" for i in range(20)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(items)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.found(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).where("n_edits = 0").collect()}
    assert got == {(i, i) for i in range(20)}


def test_decontaminate_awkward_rows(spark, monkeypatch):
    """Texts beyond a chunk, repeated rows and items, null ids, clashing columns."""
    monkeypatch.setattr(decontaminate, "CHUNK", 500)
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop    ") for _ in range(n))
    item = noise(90).strip()
    rows = [(1, noise(40_000) + item + noise(300), "i", 1), (1, noise(90), "i", 1), (2, item, "i", 1), (2, item, "i", 1), (None, item + noise(600), None, None), (3, None, None, None), (4, noise(700), "i", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, item_id int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1)], "item_id bigint, text string, id int")
    got = decontaminate.found(docs, bench)
    assert got.columns == ["doc_id", "item_id", "start_char", "end_char", "n_edits"]
    assert {(r.doc_id, r.item_id, r.n_edits) for r in got.collect()} == {(1, 7, 0), (2, 7, 0), (None, 7, 0)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(1, 90), (3, 0), (4, 700)]


# ---- 10: language ---------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(10**6 + i, t, None) for i, t in enumerate([None, "", "123 !!", "日本語", " \n "])]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string")).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in language.report(both).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert [got[10**6 + i].lang_pred for i in (0, 1, 2, 4)] == ["und"] * 4 and got[10**6 + 3].lang_pred in {"en", "fr", "de", "es"}
    nobody = language.report(both.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nobody.collect()} == {"und"}
    assert language.report(both.where("false")).count() == 0


def test_language_awkward_rows(spark):
    """A very long text, repeated rows, ties of ids in the sample, clashing columns."""
    base = [(i, "the cat sat on the mat and" if i % 2 else "le chat noir est sur la table", "en" if i % 2 else "fr", "a", 2) for i in range(60)]
    rows = base + [base[0]] * 5 + [(500, "the cat sat " * 30_000, None, "b", 3), (501, None, "en", "b", 3), (None, "", "fr", "b", 3), (None, "le chat " * 9, "fr", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, lang_pred int")
    model = language.model_of(docs, 30)
    assert model.weight.tobytes() == language.model_of(docs.repartition(5), 30).weight.tobytes()
    out = language.tagged(docs, model)
    assert out.columns == [*docs.columns, language.LANGUAGE, language.SCORE, language.CERTAINTY]
    got = out.collect()
    assert len(got) == len(rows) and {r.score for r in got} == {"a", "b"} and {r.lang_pred for r in got} == {2, 3}
    named = {(r.doc_id, len(r.text or "")): r[language.LANGUAGE] for r in got}
    assert named[500, 360_000] == "en" and named[501, 0] == named[None, 0] == language.UND and named[None, 72] == "fr"


def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(0)
    score, step = rng.normal(size=(1, 4, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    post, moves = language.forward_backward(score, np.ones((1, 4), bool), step, pairs=True)
    total, want, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        p = np.exp(sum(score[0, i, k] for i, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, k in enumerate(path):
            want[i, k] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    assert np.allclose(post[0], want / total, atol=1e-4) and np.allclose(moves, pairs / total, atol=1e-3)


def test_language_goes_on_over_cuts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [[f"w{k}".encode() for k in rng.integers(0, 40, n)] for n in (1, 150, 0, 64, 65, 700, 128)]
    step = rng.normal(size=(3, 3)).astype(np.float32) + 3 * np.eye(3, dtype=np.float32)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.zeros(0, np.uint64), step)
    monkeypatch.setattr(language.Model, "potentials", lambda self, f: np.random.default_rng(f.n).normal(size=(f.n, 3)).astype(np.float32))
    tagger = language.Tagger(model)
    tagger.word_ids([w for ws in texts for w in ws])
    got = tagger.posteriors(texts)
    for ws, mean in zip(texts, got):
        if ws:
            score = tagger.table[tagger.word_ids(ws)][None]
            want, _ = language.forward_backward(score, np.ones((1, len(ws)), bool), step)
            assert np.allclose(mean, want[0].mean(0), atol=1e-4)
            post = np.concatenate([p[m] for _, m, p in tagger.whole(tagger.word_ids(ws), np.array([len(ws)]))])
            assert np.allclose(post, want[0], atol=1e-4)


def test_pipeline_keeps_texts_of_many_languages(spark):
    import corpus_pipeline as cp

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("text is not null and lang is not null").collect()
    parts = [next(r.text for r in rows if r.lang == k and len(r.text) > 300)[:300] for k in ("de", "en", "es", "fr")]
    mixed = spark.createDataFrame([*map(tuple, rows), (10**6, " . ".join(parts), None)], "doc_id bigint, text string, lang string")
    named = language.tagged(mixed, language.model_of(mixed)).where("doc_id = 1000000").first()
    assert named[language.SCORE] < cp.LEAST_SCORE
    assert cp.language_id(spark, mixed, "").where("doc_id = 1000000").count() == 1


def test_language_sample_is_ranked_in_rounds(spark):
    # The last round's task got 256 parts of a language before, each of `sample` rows.
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("size"), F.xxhash64("id").alias("h"), F.when(F.col("id") % 50 == 0, "rare").otherwise("much").alias("lang")).cache()
    rounds = language.rounds_of(rows, 2)
    assert max(r["count"] for r in rounds[-2].groupBy("lang").count().collect()) <= 16 * 2
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.size, r.h)):
        want.setdefault(r.lang, []).append((r.size, r.h))
    assert sorted((r.lang, r.turn, r.size, r.h) for r in rounds[-1].collect()) == sorted((k, i + 1, *v[i]) for k, v in want.items() for i in range(2))


def test_rare_language_is_in_the_sample(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(3000)] + [(3000 + i, f"zorp quux vleem brak nidd {i}", "rare") for i in range(6)] + [(None, "le chat noir", "fr")] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.model_of(docs, 40)
    assert model.languages == ["en", "fr", "rare"]
    got = {r.doc_id: r[language.LANGUAGE] for r in language.tagged(docs.where("doc_id >= 2990"), model).collect()}
    assert all(got[i] == ("rare" if i >= 3000 else "en") for i in got)
    assert len(language.model_of(docs, 2).languages) == 2


def test_code_switching(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    model = language.fitted([r.text for r in rows], [r.lang for r in rows])
    tagger = language.Tagger(model)
    one = {k: next(r.text for r in rows if r.lang == k and len(r.text) > 300)[:300] for k in ("en", "fr")}
    tags = [k for _, k in tagger.words(one["en"] + " " + one["fr"])]
    half = len(language.words_of(one["en"]))
    assert tags[:half].count("en") > 0.8 * half and tags[half:].count("fr") > 0.8 * (len(tags) - half)


# ---- the pipeline ---------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    c = codec()
    assert all(r.round_trip and bpe.unpack(bytes(r.token_ids)) == c.encoding.encode_ordinary(r.text) for r in out.values())
    rows = docs.collect()
    assert len({r.text for r in out.values()}) == len(out)
    items = [decontaminate.collapsed(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in rows if any(x in decontaminate.collapsed(r.text) for x in items)}
    assert leaked and not leaked & set(out)
    # Nothing else goes but copies and near copies.
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows}
    for r in rows:
        if r.doc_id not in out and r.doc_id not in leaked:
            assert any(i != r.doc_id and len(s & sets[r.doc_id]) >= 0.8 * len(s | sets[r.doc_id]) for i, s in sets.items())
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontaminate", "bpe"]


def test_pipeline_stages_on_awkward_rows(spark, docs, rows, empty, tmp_path):
    """Every stage's columns and rows, written and read again; no column of the input is lost or changed, whatever its name."""
    import corpus_pipeline as cp

    whole = Counter(map(tuple, rows))
    for k, (name, stage) in enumerate(cp.STAGES):
        for at, table in (("docs", docs), ("empty", empty)):
            stage(spark, table, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{name}-{at}"))
            got = spark.read.parquet(str(tmp_path / f"{name}-{at}"))
            # documents has a column token_ids of its own.
            assert got.columns == [*docs.columns, *(["token_ids_", "n_tokens", "round_trip"] if k == 4 else [])]
            kept = Counter(map(tuple, got.select(*docs.columns).collect()))
            assert kept <= whole if at == "docs" else not kept
            if name == "bpe" and at == "docs":
                assert kept == whole and got.where("not round_trip").count() == 0


def test_language_stage_rejects_by_score(spark, monkeypatch):
    import corpus_pipeline as cp

    # Words that are half of one language and half of another, of four in all, are named with little certainty.
    rows = [(i * 4 + k, " ".join(f"{w}{j % 5}" for j in range(12)), lang) for i in range(20) for k, (w, lang) in enumerate((("aa", "a"), ("bb", "b"), ("cc", "c"), ("dd", "d")))]
    docs = spark.createDataFrame([*rows, (900, "zq xv wk yj " * 5, None), (901, rows[0][1], None)], "doc_id bigint, text string, lang string")
    sure = {r.doc_id: r[language.CERTAINTY] for r in language.tagged(docs, language.model_of(docs)).collect()}
    monkeypatch.setattr(cp, "LEAST_SCORE", (sure[900] + sure[901]) / 2)
    assert sure[900] < sure[901]
    kept = {r.doc_id for r in cp.language_id(spark, docs, "").collect()}
    assert 900 not in kept and {r[0] for r in rows} | {901} <= kept
