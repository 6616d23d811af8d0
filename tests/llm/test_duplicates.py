"""Near duplicates, repeated passages, decontamination and fingerprints against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from sluice.llm import decontam, line_dedup, minhash_forest, syncmers
from sluice.llm.components import components

DELIMITED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(rows, n):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(rows, n, num, den):
    sets, parent = shingle_sets(rows, n), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            linked = a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and den * both >= num * (len(a) + len(sets[j]) - both)
            if linked or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least.get(root(i)), d is None or d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies(docs):
    """Rows with a star of near copies: most are linked only through their common origin."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(20_000 + i, edited(rng, base, rng.randint(1, 9))) for i in range(60)] + [(20_500, " ".join(base)), (20_501, " ".join(base).upper())]
    chain = base[:100]
    for i in range(8):  # each is near the one before, the ends are not near each other
        chain = edited(rng, chain, 2).split()
        rows.append((21_000 + i, " ".join(chain)))
    return rows


@pytest.mark.parametrize(("n", "num", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 16)])
def test_components_are_those_of_all_pairs(spark, copies, monkeypatch, n, num, block):
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = [tuple(r) for r in minhash_forest.near_duplicates(df, n, num, 100).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(copies, n, num, 100)))


def test_one_of_each_group_stays(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    left = [r.doc_id for r in minhash_forest.without_near_duplicates(df, 3, 85, 100).collect()]
    want = {c[0] for c in brute_components(copies, 3, 85, 100) if c[3]}
    assert set(left) == want and left.count(10_005) == 1


def test_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(got.values()) == {0, 90} and got[40] == 0 and got[100] == 90


def test_regions_are_cut_deeper_where_they_are_dense(monkeypatch):
    monkeypatch.setattr(minhash_forest, "LARGE", 3)
    key = lambda *v: b"".join(x.to_bytes(4, "big") for x in v) + bytes(32 - 4 * len(v))
    keys = sorted([key(1, 1, 1, 1, i) for i in range(5)] + [key(1, 1, 1, 2, i) for i in range(2)])
    assert sorted(minhash_forest.regions(keys, 0, 7, 3)) == [(5, 7, 4)]


def brute_passages(rows, least):
    seen, out = {}, set()
    distinct = {(d, t) for d, t in rows if t is not None}
    keyed = sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text in keyed:
        run = []

        def flush(doc_id=doc_id):
            if run and sum(u[2] for u in run) >= least:
                out.add((doc_id, run[0][0], run[-1][1], sum(u[2] for u in run), run[0][3]))
            run.clear()  # noqa: B023

        for a, b in line_dedup.units(text):
            words = text[a:b].lower().split()
            k = " ".join(words)
            if k in seen:
                run.append((a, b, len(words), seen[k]))
            else:
                seen[k] = doc_id
                flush()
        flush()
    return out


def test_passages_are_those_of_a_sequential_scan(spark, docs):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60)) + "."
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(30_000 + i, f"Start {i} here.\n{passage}\nThe end {i}.") for i in range(5)] + [(30_100, f"Some words first. {passage} And some after."), (30_200, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.repeated_passages(df, line_dedup.MIN_WORDS)
    got = {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in found.collect()}
    assert got == brute_passages(rows, line_dedup.MIN_WORDS)
    caught = {g[0] for g in got}
    assert caught >= {30_001, 30_002, 30_003, 30_004, 30_100} and not caught & {30_000, 30_200}
    texts = {r.doc_id: r.text for r in line_dedup.without_passages(df, found).where("doc_id >= 30000").collect()}
    assert texts[30_000].count(passage) == 1 and texts[30_003] == "Start 3 here.\nThe end 3." and texts[30_100] == "Some words first. And some after."


def test_outliers_of_a_large_group_are_linked(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, edited(rng, base, 1)) for i in range(200)] + [(500, " ".join(base))]
    rows += [(1000 + i, " ".join([*base, *(f"more{rng.random()}" for _ in range(70))])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash_forest.near_duplicates(df, 5, 80, 100).collect()]
    assert sorted(got) == sorted(brute_components(rows, 5, 80, 100))
    assert {g[2] for g in got} == {0}


def test_no_passages(spark, empty):
    assert line_dedup.repeated_passages(empty).collect() == []
    assert minhash_forest.near_duplicates(empty).collect() == []


def brute_contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = re.findall(DELIMITED, lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in rows:
        w, hit, found = re.findall(DELIMITED, lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_is_that_of_all_windows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = next(t for _, t in rows if t and len(t.split()) > 60)
    words = base.split()
    items = [(1, " ".join(words[5:40])), (2, "word"), (3, None), (4, "..."), (5, " ".join(words[20:29])), (6, "the the the"), (7, " ".join(words[30:52]).upper()), (7, "never seen words stand here at all in any text"), (None, " ".join(words[0:12])), (8, "long long long long long long long long long long long")]
    rows += [(40_000, " ".join(words[10:30])), (40_001, "x " + " ".join(words[:60]) + " y " + " ".join(words[:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontam.contamination(df, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_contamination(rows, items)))
    kept = {r.doc_id for r in decontam.without_contaminated(df, bench).collect()}
    assert kept == {r[0] for r in brute_contamination(rows, items) if not r[5]}


def test_nothing_to_look_up(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).where("contaminated").count() == 0
    assert decontam.contamination(empty, bench).collect() == []


def test_proximity(spark):
    words = [f"w{i}" for i in range(12)]
    near = [*words[:5], "between", *words[5:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "w1 w2")], "doc_id long, text string")
    got = decontam.proximity_matches(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"), slack=3).collect()
    assert {(r.doc_id, r.item_id) for r in got} <= {(2, "7")} and all(1 <= r.distance <= 3 for r in got)


def test_proximity_finds_the_near_document(spark):
    words = [f"w{i}" for i in range(12)]
    hits = set()
    for at in range(1, 12):  # a word put in between moves one probe against the other only where it stands between them
        df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:at], "between", *words[at:]]))], "doc_id long, text string")
        hits |= {r.doc_id for r in decontam.proximity_matches(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"), slack=3).collect()}
        if hits:
            break
    assert hits == {2}


def test_fingerprints(spark, docs):
    got = syncmers.edited_fingerprints(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    order = sorted({r for r in rows}, key=lambda r: -(r[0] if r[0] is not None else -1))
    want = {}
    for i, (doc_id, text) in enumerate(order):
        third = len(text) // 3
        want[doc_id] = (len(text), hashlib.sha256((text[: len(text) - third] + order[(i + 1) % len(order)][1][:third]).encode()).hexdigest())
    assert len(got) == len(rows) and all((r.n_chars, r.edited_sha256) == want[r.doc_id] for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    long = [r for r in got if r.n_chars > 300 and r.doc_id and r.doc_id < 10_000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 > 0.1 > sum(r.near_next for r in long) / len(long)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.edited_fingerprints(docs.where("false")).collect() == []


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    df = spark.createDataFrame([(" ".join(words),), ("other start here " + " ".join(words[50:120]) + " other end",)], "text string")
    whole, part = ({(a["pos"], a["hash"]) for a in r.a} for r in syncmers.with_anchors(df, "text", "a").collect())
    inside = {h for p, h in whole if 50 <= p <= 116}
    assert inside <= {h for _, h in part}
    # a window of consecutive k-mers can't be without an anchor for long
    places = sorted(p for p, _ in whole)
    assert len(places) > 200 / 3 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 8


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(*values):
    """Spark's 64-bit hash of several longs: each is the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", signed(v) if v >= 0 else v), seed & ((1 << 64) - 1))
    return signed(seed)


def brute_sketch(text):
    """The syncmers of a text by their definition: K-word windows whose least S-word substring lies at an edge."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    own = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if len(own) < syncmers.K:
        whole = hash_longs(*own) if own else signed(xxhash.xxh64_intdigest(text.encode(), 42))
        anchors = [(whole, 0)] if text else []
    else:
        anchors = []
        for i in range(len(own) - syncmers.K + 1):
            inner = [hash_longs(*own[j : j + syncmers.S]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
            if min(inner) in (inner[0], inner[-1]):
                anchors.append((hash_longs(inner[0], inner[-1]), i))
    first = {}
    for x, pos in anchors:
        first.setdefault(x >> 32, pos)
    return sorted(first.items())[: syncmers.SIZE]


def test_fingerprints_are_those_of_the_definition(spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(300)}" for _ in range(2000)]
    rows = [(i, " ".join(words[rng.randrange(1500) :][: rng.randint(1, 400)])) for i in range(30)] + [(50, ""), (51, "!!"), (52, "one Two"), (53, "a b c d"), (54, None)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    shown = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x, _ in s)

    def alike(a, b):
        both = sorted({x for x, _ in a} | {x for x, _ in b})[: syncmers.SIZE]
        return len([x for x in both if x in dict(a) and x in dict(b)]) / len(both) if both else 1.0

    for at, (i, text) in enumerate(order):
        after, third = order[(at + 1) % len(order)][1], len(text) // 3
        a, b, c = brute_sketch(text), brute_sketch(text[: len(text) - third] + after[:third]), brute_sketch(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(a), shown(b))
        assert (r.near_edited, r.near_next) == pytest.approx((alike(a, b), alike(a, c)))
        apart = sorted(dict(b)[x] - p for x, p in a if x in dict(b))
        shift = apart[(len(apart) - 1) // 2] if apart else None
        assert r.shift_edited == shift and r.aligned_edited == pytest.approx(apart.count(shift) / len(a) if apart else 0.0)


def test_texts_of_one_word(spark):
    rows = [(1, "word " * 100_000), (2, "word " * 8_000), (3, "other word")]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "word " * 400)], "item_id long, text string")).collect()}
    assert (got[1].n_hit, got[2].n_hit, got[3].n_hit) == (100_000, 8_000, 0)


def test_white_space_takes_linear_time():
    assert list(line_dedup.units("a" + " " * 1_000_000 + "b\n \n" + "\t" * 1_000_000 + "c. d")) == [(0, 1_000_002), (2_000_005, 2_000_007), (2_000_008, 2_000_009)]


def test_every_repeated_line_goes_by_default(spark):
    rows = [(1, "stock phrase\nfirst text"), (2, "second text\nStock  phrase"), (3, "first text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end, r.first_doc_id) for r in line_dedup.repeated_passages(df).collect()} == {(2, 12, 25, 1), (3, 0, 10, 1)}
    assert {(r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect()} == {(1, "stock phrase\nfirst text"), (2, "second text")}


def test_rows_that_share_an_id_but_not_a_text(spark):
    rng = random.Random(31)
    one, two = ([f"w{rng.randrange(9000)}" for _ in range(200)] for _ in range(2))
    rows = [(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two)), (2, edited(rng, one, 3)), (3, "alone"), (None, " ".join(one))]
    left = minhash_forest.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[4], rows[5]], left.schema).collect()))


def test_all_near_copies_of_a_dense_group_are_found(spark):
    rng = random.Random(41)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.randint(1, 4))) for i in range(700)]  # more than a block
    got = [tuple(r) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows, 3, 85, 100))


def test_frequent_units_and_others_give_the_same_passages(spark, monkeypatch):
    rows = [(i, "a line that every text holds.\n" + f"a line of group {i % 4}.\n" + f"one of its own, {i}.") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for frequent in (1, 5, 1000):  # none, only the common line, every repeated one is frequent
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        results.append(sorted(map(tuple, line_dedup.repeated_passages(docs).collect())))
    assert results[0] == results[1] == results[2]
    assert {r[0] for r in results[0]} == set(range(1, 24))


def test_sets_alike_at_once_are_those_alike_one_by_one(monkeypatch):
    monkeypatch.setattr(minhash_forest, "MATRIX_COLUMNS", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 45))).astype(np.uint64) for _ in range(60)]
    got = minhash_forest._alike(sets[:25], sets[20:], 60, 100)
    assert got.tolist() == [[minhash_forest._linked(a, b, 60, 100) for b in sets[20:]] for a in sets[:25]]
    assert not got[:, [len(x) == 0 for x in sets[20:]]].any() and got.any()


def test_a_chained_group_of_unlike_texts_meets_few_candidates(spark, monkeypatch):
    rng = random.Random(43)
    words = lambda tag, n: " ".join(f"{tag}{rng.randrange(9000)}" for _ in range(n))
    stock = [words("s", 20) for _ in range(6)]
    texts = [f"{rng.choice(stock)} {rng.choice(stock)} {words('u', 12)}" for _ in range(900)]
    texts += [edited(rng, texts[7 * i].split(), 1) for i in range(60)]
    rows = list(enumerate(texts))
    compared = spark.sparkContext.accumulator(0)
    cross = minhash_forest._cross

    def counted(*args):
        run = cross(*args)

        def wrapped(batches):
            for batch in batches:
                compared.add(batch.num_rows)
                yield from run(iter([batch]))

        return wrapped

    monkeypatch.setattr(minhash_forest, "_cross", counted)
    got = [tuple(r) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows, 3, 85, 100))
    assert 0 < compared.value < len(rows)
