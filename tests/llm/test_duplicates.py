"""SimHash groups, chunk fingerprints and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_TEXTS, collected, no_documents, odd_documents
from tabulary.llm import fingerprints, simhash, suffixes
from tabulary.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    source = random.Random(4)
    words = [f"w{n}" for n in range(40)]
    rows = []
    for group in range(12):
        base = [source.choice(words) for _ in range(60)]
        for copy in range(12):
            text = list(base)
            for _ in range(copy % 3):
                text[source.randrange(60)] = source.choice(words)
            rows.append((1000 * group + copy, " ".join(text)))
    rows += [(90_000 + n, t) for n, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {n: slow_fingerprint(t) for n, t in rows}
    pairs = [
        (a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 2
    ]
    groups = slow_groups(bits, pairs)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {n: (f"{bits[n]:016x}", groups[n]) for n in bits}


def test_hot_block_is_salted_without_loss(spark):
    """More fingerprints share a block than one group may hold."""
    source = random.Random(5)
    center = source.getrandbits(64)
    numbers = {center}
    while len(numbers) < 3000:
        own = center
        for _ in range(source.randint(1, 6)):
            own ^= 1 << source.randrange(30)
        numbers.add(own)
    numbers |= {source.getrandbits(64) for _ in range(200)}
    signed = {n: n - (1 << 64) if n >> 63 else n for n in numbers}
    links = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "bits long"))
    found = {r.node: r.component for r in components(links).collect()}
    array = np.array(sorted(numbers), dtype=np.uint64)
    pairs = [
        (int(array[n]), int(array[n + 1 + m]))
        for n in range(len(array))
        for m in np.flatnonzero(np.bitwise_count(array[n] ^ array[n + 1 :]) <= 2)
    ]
    expected = slow_groups(numbers, pairs)
    sets = {}
    for n, own in expected.items():
        sets.setdefault(own, set()).add(signed[n])
    got = {}
    for v in signed.values():
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 300)] + [(7, 7)]
    found = dict(collected(components(spark.createDataFrame(links, "a long, b long"))))
    expected = slow_groups({n for link in links for n in link}, links)
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[n].component_id for n in range(4)} == {0}
    assert {by_id[n].fingerprint for n in range(4)} == {"0" * 16}
    assert by_id[8].component_id == by_id[9].component_id == 8
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 4, 5, 6, 7, 8]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id"]
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


# Near duplicates of the pipeline


def test_pipeline_keeps_the_smallest_id_of_each_simhash_group(spark):
    import corpus_pipeline

    source = random.Random(11)
    words = [f"w{n}" for n in range(3000)]
    texts = []
    for size in (5, 40, 600, 2000):
        for _ in range(10):
            base = [source.choice(words) for _ in range(size)]
            texts.append(" ".join(base))
            texts.append("\n".join(base).upper())
            for _ in range(6):
                base[source.randrange(size)] = "changed"
                texts.append(" ".join(base))
    texts += ["", None, texts[0], " \t "]
    rows = list(enumerate(texts))
    bits = {n: slow_fingerprint(t) for n, t in rows}
    pairs = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 2]
    assert any(bits[a] != bits[b] for a, b in pairs)
    groups = slow_groups(bits, pairs)
    df = spark.createDataFrame(
        [(n, t, "en", "src", len(t or "")) for n, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = corpus_pipeline.deduplicated(spark, df, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))
    assert corpus_pipeline.deduplicated(spark, odd_documents(spark), "").count() == 7
    assert corpus_pipeline.deduplicated(spark, no_documents(spark), "").count() == 0


# Chunk fingerprints


def test_chunks_cover_the_text_and_resist_shifts():
    source = random.Random(6)
    data = bytes(source.choice(b"abcdefgh \n") for _ in range(20_000))
    found = fingerprints.chunks(data)
    assert sum(length * n for (_, length), n in found.items()) == len(data)
    assert max(length for _, length in found) <= fingerprints.MOST
    shifted = fingerprints.chunks(b"a few bytes" + data)
    assert fingerprints.likeness(found, shifted) > 0.95
    other = bytes(source.choice(b"abcdefgh \n") for _ in range(20_000))
    assert fingerprints.likeness(found, fingerprints.chunks(other)) < 0.05
    assert fingerprints.parsed(fingerprints.printed(found)) == found


def test_gear_is_the_rolling_hash():
    data = bytes(range(200)) * 2
    rolled, expected = fingerprints.gear(data), []
    for end in range(len(data)):
        window = data[max(0, end - 31) : end + 1]
        expected.append(
            sum(int(fingerprints.GEAR[b]) << k for k, b in enumerate(reversed(window))) % (1 << 32)
        )
    assert rolled.tolist() == expected


def slow_order(rows):
    known = [r for r in rows if r[0] is not None]
    return sorted(known, key=lambda r: -r[0])


def test_edited_texts_follow_descending_ids(spark):
    source = random.Random(7)
    rows = [
        (n * 3, "".join(source.choice("abc déf\n") for _ in range(source.randint(0, 900))))
        for n in range(300)
    ]
    rows[5] = (15, None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r for r in fingerprints.edit_likeness(df).collect()}
    ordered = [(n, t or "") for n, t in slow_order(rows)]
    assert len(found) == len(rows)
    for place, (n, text) in enumerate(ordered):
        following = ordered[(place + 1) % len(ordered)][1]
        edited = fingerprints.edited_text(text, following)
        own, new = (fingerprints.chunks(t.encode()) for t in (text, edited))
        row = found[n]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprints.printed(own)
        assert row.near_edited == fingerprints.likeness(own, new)
        assert row.near_next == fingerprints.likeness(own, fingerprints.chunks(following.encode()))


def test_edit_likeness_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = fingerprints.edit_likeness(df).collect()
    assert len(rows) == df.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[1] == "" and prints[8] == prints[9]
    assert fingerprints.edit_likeness(no_documents(spark)).count() == 0
    one = fingerprints.edit_likeness(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(df).count() == df.count()


def test_rows_of_one_id_or_none_lie_in_several_slots(spark):
    source = random.Random(17)
    texts = ["".join(source.choice("abcdef ") for _ in range(40 + n)) for n in range(400)]
    ids = [None if n % 3 == 0 else "hot" if n % 3 == 1 else f"id{n}" for n in range(400)]
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    ordered, slots = fingerprints.in_order(df)
    own = ordered.filter("NOT borrowed")
    for condition in ("doc_id IS NULL", "doc_id = 'hot'"):
        assert own.filter(condition).select("slot").distinct().count() > 2
    placed = own.orderBy("slot", df["doc_id"].desc_nulls_last()).select("doc_id").collect()
    expected = sorted((i for i in ids if i), reverse=True) + [None] * ids.count(None)
    assert [r.doc_id for r in placed] == expected and ordered.count() == 400 + slots
    found = fingerprints.edit_likeness(df).collect()
    tie = {r.text: r.tie for r in df.selectExpr("text", "xxhash64(text) AS tie").collect()}
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", tie[r[1]]), reverse=True)
    wanted = Counter()
    for place, (own_id, text) in enumerate(line):
        following = line[(place + 1) % len(line)][1]
        edited = fingerprints.edited_text(text, following)
        wanted[own_id, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in found) == wanted


# Repeated strings


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_order(values):
    text = np.array(values, dtype=np.int64)
    expected = sorted(range(len(values)), key=lambda n: values[n:])
    assert suffixes.suffix_order(text).tolist() == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=8, max_size=120), st.integers(8, 20))
def test_repeated_starts(text, length):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.arange(max(0, len(data) - length + 1))
    if len(starts):
        counts = Counter(text[n : n + length] for n in starts)
        expected = [counts[text[n : n + length]] > 1 for n in starts]
        assert suffixes.repeated_starts(data, starts, length).tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé ", max_size=300))
def test_cover_deals_out_every_start_once(text):
    data, length = text.encode(), 40
    starts = [s + k for _, s, n, _ in suffixes.cover(data, length, 4) for k in range(n)]
    assert starts == list(range(max(0, len(data) - length + 1)))


def slow_kept(rows, length):
    texts = [(n, (t or "").encode()) for n, t in rows]
    counts = Counter(
        data[p : p + length] for _, data in texts for p in range(len(data) - length + 1)
    )
    out = []
    for n, data in texts:
        hit = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if counts[data[p : p + length]] > 1:
                hit[p : p + length] = b"\x01" * length
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(1 for p, h in enumerate(hit) if h and (p == 0 or not hit[p - 1]))
        out.append((n, len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating_rows(source):
    shared = ["".join(source.choice("abcdé \n") for _ in range(source.randint(30, 200))) for _ in range(6)]
    rows = []
    for n in range(60):
        parts = []
        for _ in range(source.randint(0, 6)):
            parts.append(source.choice(shared)[source.randint(0, 20) :])
            parts.append("".join(source.choice("abcd") for _ in range(source.randint(0, 50))))
        rows.append((n, "".join(parts)))
    rows += [(100, "xy" * 200), (101, None), (102, ""), (103, rows[3][1]), (None, rows[4][1]), (None, None)]
    return rows + [rows[5]]


def test_repeats_against_brute_force(spark, monkeypatch):
    rows = repeating_rows(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = slow_kept(rows, 60)
    found = suffixes.remove_repeats(df, length=60, gram_bits=4)
    assert sorted(collected(found, *columns), key=str) == expected
    assert any(removed for _, _, removed, _, _ in expected)
    for row in found.collect():
        assert hashlib.sha256(bytes(row.kept)).hexdigest() == row.kept_sha256
    # Grams with many stretches are counted by digests instead, with the same result.
    monkeypatch.setattr(suffixes, "HOT_GRAM", 2)
    found = suffixes.remove_repeats(df, length=60, gram_bits=4)
    assert sorted(collected(found, *columns), key=str) == expected
    monkeypatch.setattr(suffixes, "SLICE", 64)
    monkeypatch.setattr(suffixes, "HOT_GRAM", 2000)
    starts = [s + k for _, s, n, _ in suffixes.cover(b"ab" * 300, 60, 4) for k in range(n)]
    assert starts == list(range(541))


def test_repeats_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = suffixes.remove_repeats(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].n_removed == 5000 and by_id[6].n_spans == 1
    assert by_id[7].n_removed == 6000
    assert by_id[0].n_bytes == 0 and by_id[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffixes.remove_repeats(no_documents(spark)).count() == 0
