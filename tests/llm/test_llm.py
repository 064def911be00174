"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellum.llm import classifier, components, exact_dedup, mixing, packing, quality_rules, sharding, simhash, similarity, substring_dedup, warc, windows
from tessellum.llm.common import chosen, materialize, new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, texts = say(70), []
    for i in range(n):
        t = say(rng.randint(1, 220))
        if i % 4 == 0:
            t += ". " + passage + "\n" + say(30)
        if i % 10 == 3:
            t = texts[i // 2]
        if i % 10 == 7:
            w = texts[i // 2].split()
            w[len(w) // 2 :] = w[len(w) // 2 + 1 :]
            t = " ".join(w)
        texts.append(t)
    texts += ["", "   \n", "one", "same line here\n" * 60, "x " * 300, say(40).upper(), say(3)]
    rows = [(i, t, "en", f"src{i % 5}" if i % 3 else "src0", len(t)) for i, t in enumerate(texts)]
    return [*rows, (900, None, None, None, None), (901, None, "en", "src1", 0), (None, texts[5], "en", "src2", 1), rows[8], rows[8]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("_n", F.lit(1)).withColumn("kept", F.lit("x"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("most", [exact_dedup.BROADCAST_PAIRS, 0])
def test_exact_dedup(docs, rows, nothing, most):
    docs = docs.withColumnsRenamed({"lang": "_hit", "source": "_slot"}).withColumn("full_hash", F.lit(1))
    found = exact_dedup.exact_dedup(docs, broadcast_pairs=most)
    got = found.collect()
    assert len(got) == len(rows) and {"_hit", "_slot", "_n", "n_chars"} <= set(found.columns)
    assert sorted(map(str, (r[:2] + r[3:4] for r in rows))) == sorted(str((r.doc_id, r.text, r._slot)) for r in got)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(low)].append(r[0])
    for r in got:
        ids = groups[(r.text or "").translate(low)]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_repeated_bytes(docs, rows, nothing):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = collections.defaultdict(list)
    for r, t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        expected[r[0], t].append([(m.start(), m.end()) for m in re.finditer(b"\1+", mask)])
    got = substring_dedup.repeated_bytes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s.stop) for s in r.spans or ()] == expected[r.doc_id, bytes(r.t)][0]
    assert substring_dedup.repeated_bytes(nothing).count() == 0


def test_repeated_words(docs, rows, nothing):
    first = {}
    order = lambda d: float("inf") if d is None else d
    for r in rows:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, float("inf")), order(r[0]))
    got = substring_dedup.repeated_words(docs, batches=4).collect()
    assert len(got) == len(rows)
    for r in got:
        w = bytes(r.t).split()
        mask = bytearray(len(w))
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(r.doc_id):
                mask[i : i + 50] = b"\1" * 50
        assert [(s.start, s.stop) for s in r.spans or ()] == [(m.start(), m.end()) for m in re.finditer(b"\1+", mask)]
    assert substring_dedup.repeated_words(nothing).count() == 0


@pytest.mark.parametrize("wide", [windows.WIDE, 1])
def test_repeat_groups_have_all_their_places(spark, docs, rows, nothing, monkeypatch, wide):
    monkeypatch.setattr(windows, "WIDE", wide)
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").encode())
    groups = collections.defaultdict(list)
    for r in substring_dedup.repeat_groups(docs).collect():
        groups[r.grp, r.length].append((r.doc_id, r.start))
    corpus_ = [(d, t) for d, ts in texts.items() for t in ts]
    covered = collections.defaultdict(set)
    assert len(groups) > 30
    for (_, n), places in groups.items():
        d, start = places[0]
        said = next(t for t in texts[d] if t[start : start + n] and all(any(u[s : s + n] == t[start : start + n] for u in texts[e]) for e, s in places))[start : start + n]
        everywhere = sorted(str((e, m.start())) for e, t in corpus_ for m in re.finditer(b"(?=" + re.escape(said) + b")", t))
        assert len(said) == n >= 200 and sorted(map(str, places)) == everywhere and len(places) > 1
        for e, s in places:
            covered[e].update(range(s, s + n))
    spans = collections.defaultdict(set)
    for r in substring_dedup.repeated_bytes(docs).collect():
        for s in r.spans or ():
            spans[r.doc_id].update(range(s.start, s.stop))
    assert {k: v for k, v in covered.items() if v} == dict(spans)
    assert substring_dedup.repeat_groups(nothing).count() == 0


def test_a_passage_of_many_contexts(spark):
    rng = random.Random(9)
    say = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage, part = say(420), say(90)
    texts = [say(rng.randint(0, 150)) + (passage if i % 3 else passage[:260] + part) + say(rng.randint(0, 150)) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for r in substring_dedup.repeated_bytes(df).collect():
        t = texts[r.doc_id]
        mask = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        assert [(s.start, s.stop) for s in r.spans] == [(m.start(), m.end()) for m in re.finditer(b"\1+", mask)]
    sizes = collections.Counter((r.grp, r.length) for r in substring_dedup.repeat_groups(df).collect())
    assert max(sizes.values()) == 80


def test_an_index_goes_on_where_it_ended(spark, docs, rows, tmp_path):
    key = lambda found: sorted((r.d, r.h, a, b) for r in found.groupBy("d", "h").agg(F.flatten(F.collect_list("runs")).alias("runs")).collect() for a, b in windows.cover(r.runs, 50))
    texts = substring_dedup._identified(docs, "doc_id", "text", substring_dedup.LAST).cache()
    root = f"file://{tmp_path}/index"
    once = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/once", buckets=3).add(texts)
    found = None
    for low, high in ((-1, 30), (30, 31), (31, 60), (60, 90), (90, substring_dedup.LAST)):
        index = substring_dedup.FingerprintIndex(spark, root, buckets=3, fanout=2)  # opened anew each time
        for run in index.state["runs"]:
            spark.sql(f"DROP TABLE IF EXISTS {run['name']}")  # as in another session
        got = index.add(texts.where((F.col("d") > low) & (F.col("d") <= high)), texts.where(F.col("d") <= high))
        found = got if found is None else found.union(got)
    assert key(found) == key(once) and len(key(once)) > 5
    assert len(index.state["runs"]) <= 3 and max(r["tier"] for r in index.state["runs"]) >= 2
    plan = index._read(index.state["runs"][0]).join(index._read(index.state["runs"][-1]).hint("merge"), "anchor")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        index.add(texts)
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, root, buckets=3, gram=8)


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=(1 << 20) + 5000))
    part = long[(1 << 20) - 700 : (1 << 20) + 300]
    df = spark.createDataFrame([(1, long), (2, "zz " + part + " yy")], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in substring_dedup.repeated_bytes(df).collect()}
    assert spans == {1: [((1 << 20) - 700, (1 << 20) + 300)], 2: [(3, 3 + len(part))]}
    found = {r.doc_id: [(s.start, s.stop) for s in r.spans or ()] for r in substring_dedup.repeated_words(df).collect()}
    whole, words = long.split(), part.split()
    inner = words[1:-1]
    at = next(i for i in range(len(whole)) if whole[i : i + len(inner)] == inner)
    assert found[1] == [] and len(found[2]) == 1
    a, b = found[2][0]
    assert b - a >= len(inner) and at > 0


def test_repeats_at_every_joint_of_pieces(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghij", k=4 * windows.PIECE))
    joints = [k * (windows.PIECE - 1024) + shift for k in (1, 2, 3) for shift in (-300, 0, 724, 900, 1024)]
    rows = [(0, long)] + [(1 + i, "é" + long[a : a + 260] + "ü") for i, a in enumerate(joints)]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans or ()] for r in substring_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want: list[list[int]] = []
    for a in sorted(joints):
        if want and a <= want[-1][1]:
            want[-1][1] = a + 260
        else:
            want.append([a, a + 260])
    assert got.pop(0) == [tuple(x) for x in want]
    assert all(x == [(2, 262)] for x in got.values())


def test_words_of_long_texts_have_the_hashes_of_short_ones(monkeypatch):
    rng = random.Random(7)
    for _ in range(200):
        words = [bytes(rng.choices(b"abc", k=rng.choice([1, 5, 31, 32, 33, 80]))) for _ in range(rng.randint(0, 30))]
        text = b"".join(w + bytes(rng.choices(b" \n\t", k=rng.randint(1, 40))) for w in words)
        text = rng.choice([text, b" " * 40 + text, text.rstrip()])
        monkeypatch.setattr(windows, "PIECE", 32)
        got = windows.symbols_of(text, "words")
        monkeypatch.undo()
        each = [windows.symbols_of(w, "words")[0] for w in words]
        assert len(got) == len(words)
        assert all(g == e for g, e, w in zip(got, each, words, strict=True) if len(w) <= 32)
        assert len(set(got.tolist())) == len(set(words))


def test_maximal_repeats_have_all_occurrences():
    texts = [b"__abcdefgh--", b"++abcdefgh==", b"abcdefghxyz", b"qqqqq"]
    got = dict(windows.maximal_repeats(texts, [len(t) - 3 for t in texts], 4))
    assert sorted(got[8]) == [(0, 2), (1, 2), (2, 0)]
    assert list(windows.maximal_repeats([b"abcd"], [1], 4)) == []


def test_simhash(docs, rows, nothing):
    fps = {}
    for r in rows:
        fps[r[0], r[1]] = simhash.simhash((r[1] or "").encode())
    a = np.array([fps[r[0], r[1]] for r in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            parent[find(i)] = find(int(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    expected = sorted((str(r[0]), least[find(i)]) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_at_three_bits_and_chains(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = set(base)
    for b in base[:20]:
        x = b
        for _ in range(6):
            for k in rng.sample(range(63), 3):
                x ^= 1 << k
            values.add(x)
    v = sorted(values)
    got = {r.fp: r.root for r in simhash.classes(spark.createDataFrame([(x,) for x in v], "fp long")).collect()}
    seen = {}
    for x in v:
        if x in seen:
            continue
        todo, group = [x], {x}
        while todo:
            y = todo.pop()
            near = [z for z in v if z not in group and (y ^ z).bit_count() <= 3]
            group.update(near)
            todo += near
        seen.update(dict.fromkeys(group, min(group)))
    assert got == seen


def test_components_of_a_star_and_a_path(spark):
    links = [(1, k) for k in range(2, 200)] + [(k, k + 1) for k in range(300, 360)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 200)}, **{k: 300 for k in range(301, 361)}}


@pytest.mark.parametrize("most", [components.TASK_LINKS, 40, 0])
def test_components_by_rounds_and_in_one_task(spark, most):
    rng = random.Random(5)
    links = [(rng.randrange(-300, 300) << 40, rng.randrange(-300, 300) << 40) for _ in range(260)] + [(7, 7)] + [(1 << 62, (1 << 62) - k) for k in range(1, 50)]
    links += [(k, k + 1) for k in range(300, 360)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3), task_links=most).collect()
    assert len(got) == len({r.a for r in got}) and {r.a: r.b for r in got} == {a: b for a, b in root.items() if a != b}
    assert not components.components(spark.createDataFrame([(1, 1)], "a long, b long"), task_links=most).collect()


def test_components_of_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(500)], "a long, b long")
    track, group = spark.sparkContext.statusTracker(), f"links-{random.random()}"
    spark.sparkContext.setJobGroup(group, "links")
    try:
        assert {r.b for r in components.components(links).collect()} == {0}
    finally:
        spark.sparkContext.setJobGroup("", "")
    stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
    # a round over all of the links takes more than ten stages, whose tasks the driver holds
    assert 0 < sum(track.getStageInfo(s).numTasks for s in stages if track.getStageInfo(s)) < 60


def test_mix(docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free -= over or free
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 16 for s in names)
    assert mixing.mix_sources(nothing).count() == 0


def test_sainte_lague_is_by_highest_quotients(spark):
    votes = {f"p{i}": v for i, v in enumerate([100, 81, 53, 30, 7, 1])}
    for seats in (0, 1, 3, 17, 40):
        df = spark.createDataFrame([(1, k, v) for k, v in votes.items()], "g int, p string, v long")
        got = {r.p: r.seats for r in mixing.sainte_lague(df, ["g"], "v", F.lit(seats), ["p"]).collect()}
        expected = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(sorted(votes), key=lambda k: votes[k] / (2 * expected[k] + 1))
            expected[best] += 1
        assert got == expected


def test_rule_counts(docs, rows, nothing):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in text[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_repeated_windows_don_t_rest_on_their_hash(spark):
    rng = random.Random(8)
    lists = [[], None, ["a"], ["a", "b", "c"], ["a"] * 7] + [rng.choices("abcd", k=rng.randint(3, 90)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, w array<string>")
    weak = lambda a, b, c: F.pmod(F.xxhash64(a, b, c), F.lit(5)).cast("long")
    for hash_ in (F.xxhash64, weak):
        for r in quality_rules.with_repeated_words(df, "w", "n", hash_).collect():
            w = lists[r.id] or []
            n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            assert r.n == len({i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)})


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nX: y", "WARC/1.1\r\n\r\n" * 3), (5, "u", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("payload", F.lit(1))
    folder = new_path(spark, "warc")
    manifest = warc.archive_pages(df, folder, partitions=2)
    assert sum(r.records for r in manifest.collect()) == 6
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_warc(spark, folder).collect())
    expected = []
    for i, _, h in pages:
        top = max(p for p, _, x in pages if (x or "") == (h or ""))
        expected.append((i, len((h or "").encode()), "response" if i == top else "revisit", None if i == top else top, warc.digest32((h or "").encode())))
    assert got == sorted(expected)
    empty = new_path(spark, "warc")
    assert warc.archive_pages(df.limit(0), empty).count() == 0


def test_warc_reader_finds_damage():
    record = warc.encode_record({"WARC-Type": "response"}, b"block")
    assert [b for _, b in warc.read_records([record[:7], record[7:] + record])] == [b"block", b"block"]
    with pytest.raises(warc.WarcError):
        list(warc.read_records([record[:-4]]))
    with pytest.raises(warc.WarcError):
        warc._page_row({"Content-Length": "0", "WARC-Type": "response", "WARC-Payload-Digest": "sha1:X", "WARC-Record-ID": "<urn:page:1>"}, b"Content-Length: 1\r\n\r\na")


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, shard_tokens=9000, width=1024).collect()
    streams, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        streams[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    text = {r[0]: r[1] or "" for r in rows}
    for doc, pieces in streams.items():
        expected = plain.encode(text[doc], add_special_tokens=False).ids + [2]
        copies = sum(r[0] == doc for r in rows)
        assert sum(len(p) for _, p, _ in pieces) == copies * len(expected) and all(expected[s : s + len(p)] == p and n == len(expected) for s, p, n in pieces)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(nothing).count() == 0


def test_ids_of_every_letter_before_a_mark():
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), packing.WordTokenizer(path)
    letters = [chr(c) for c in range(0x20, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in letters for x in (f"{c}. {c.upper()}", f"x {c}! e\u0301, b{c}y: a\u0307.")]
    texts += ["\u0130.", "x \u0130. y", "\u0958. \u0130\u0130;", "a.\x1cb. c", "\u03a3\u03a3. A\u03a3", "a\u0338. b"]
    for text, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text)[0].tolist() == e.ids, ascii(text)


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(20):
        ends = np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 8))])
        total = int(ends[-1])
        soft = np.array(sorted(rng.sample(range(1, total + 1), min(total, 4))))
        cost = lambda cuts: sum((0 if (n & (n - 1)) == 0 else 8 - n) for n in np.diff([0, *cuts]).tolist()) + sum(0 if c in ends else 2 if c in soft else 3 for c in cuts)  # noqa: B023, E731
        got = packing.plan_cuts(ends, soft, 8, soft_cost=2, hard_cost=3, grid=1)
        best = {0: 0}
        for j in range(1, total + 1):
            best[j] = min(best[i] + (0 if ((j - i) & (j - i - 1)) == 0 else 8 - j + i) for i in range(max(0, j - 8), j)) + (0 if j in ends else 2 if j in soft else 3)
        assert got[-1] == total and max(np.diff([0, *got])) <= 8 and cost(got) == best[total]


def test_classifier_learns_and_holds_out(spark, nothing):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(40)]
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, quality int")
    model = classifier.train_quality(df, lab, sample=200)
    got = {r.doc_id: r for r in classifier.score_quality(df, model).withColumn("held", classifier.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _ in rows if got[i].held]
    assert len(held) > 40 and np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.95
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert classifier.score_quality(nothing, classifier.train([], [])).count() == 0


def test_shards(spark, docs, rows):
    store = sharding.shard_arrivals(docs, new_path(spark, "store"), arrivals=5, target_mb=0.05, fanout=2)
    back = store.read().select("doc_id", "text").collect()
    assert sorted(map(str, back)) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert store.version() >= 5
    was = store.version()
    with pytest.raises(RuntimeError):
        store._commit(was, [])
    assert store.version() == was
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, new_path(spark, "store")).read()


def test_two_writers_of_a_store(spark, monkeypatch):
    root = new_path(spark, "store")
    one, two = sharding.ShardStore(spark, root, target_mb=1, fanout=2), sharding.ShardStore(spark, root, target_mb=1, fanout=2)
    batch = lambda k: spark.range(10 * k, 10 * k + 10).coalesce(1)
    one.append(batch(0))
    write = two._write

    def slow(df, name):  # the other writer commits, merges and cleans while this one has written but not committed
        shards = write(df, name)
        one.append(batch(1))
        one.compact()
        one.vacuum()
        return shards

    monkeypatch.setattr(two, "_write", slow)
    two.append(batch(2))
    assert sorted(r.id for r in one.read().collect()) == list(range(30))
    one.compact()
    one.vacuum(0)
    assert sorted(r.id for r in two.read().collect()) == list(range(30)) and len(two.manifest()) == 1


def test_quality_on_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train_quality(table, labels)
    scored = classifier.score_quality(table, model).join(labels, "doc_id").where(classifier.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    good, bad = (scored.score[scored.quality == k].to_numpy() for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5 and np.mean(good[:, None] > bad[None]) > 0.85
    # a bound in bytes keeps whole texts with the lowest hashes
    assert classifier.train_quality(table, labels, sample_bytes=1).bias != model.bias


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1


def near_groups(texts):
    """The least place of each text's component of similar texts, by all pairs."""
    sets, parent = [similarity.shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on what the one before kept, against brute force; then run() as a whole."""
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    kept = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mix", "window_packing"]

    def step(name, docs):
        out = stages[name](spark, docs, sf)
        assert name == "window_packing" or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = classifier.train_quality(table, spark.read.parquet(f"{sf}/labels.parquet"))
    good = step("quality_classifier", table)
    kept = [r for r in kept if model.score((r[1] or "").encode()) >= 0.3]
    assert sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in kept)

    exact = step("exact_dedup", good)
    groups = collections.defaultdict(list)
    for r in kept:
        groups[(r[1] or "").encode().lower()].append(r[0])
    last = {max(ids) for ids in groups.values()}
    kept = sorted(r for r in kept if r[0] in last)
    assert sorted(r.doc_id for r in exact.collect()) == [r[0] for r in kept]

    near = step("simhash_near_dedup", exact)
    kept = [r for i, r in enumerate(kept) if near_groups([(x[1] or "").encode() for x in kept])[i] == i]
    assert sorted(r.doc_id for r in near.collect()) == [r[0] for r in kept]

    mixed = step("source_mix", near).collect()
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix_sources(near).collect() if r.size}
    expected = collections.Counter({d: round(x + 1e-9) for d, x in taken.items()})
    assert collections.Counter(r.doc_id for r in mixed) == +expected

    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    packed = step("window_packing", spark.read.parquet(f"{tmp_path}/source_mix")).collect()
    text = {r.doc_id: r.text or "" for r in mixed}
    got = collections.defaultdict(collections.Counter)
    for r in packed:
        for k, x in enumerate(np.frombuffer(bytes(r.ids), "<u4").tolist()):
            got[r.doc_id][r.start + k, x] += 1
    for d, n in collections.Counter(r.doc_id for r in mixed).items():
        ids = plain.encode(text[d], add_special_tokens=False).ids + [2]
        assert got[d] == {(k, x): n for k, x in enumerate(ids)}

    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sum(r.length for r in whole) == sum(r.length for r in packed) and {r.doc_id for r in whole} == set(got)

    exact = corpus_pipeline.exact_copies(spark, docs, sf)
    assert exact.count() == exact.select(F.lower("text")).distinct().count()
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in exact.collect()), key=lambda r: (r[0] is None, r[0]))
    least = near_groups([t for _, t in rows])
    expected = {rows[i][0] for i in least}
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.near_copies(spark, exact, sf).collect()))) == sorted(map(str, expected))


def test_oracles_name_queries():
    from tessellum.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 11
    assert hashlib.sha256(b"").hexdigest()


def test_near_copies_are_all_pairs_at_eight_tenths_and_no_others(spark):
    rng = random.Random(11)
    say = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passage, texts = say(46), []
    for k in [*range(1, 30), *([60] * 25), *([150] * 25), *([400] * 15), 3000]:
        base = say(k)
        texts.append(base)
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(1, max(1, k // 22))):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = say(rng.randint(0, 1))
            texts.append(w)
    texts += [passage + say(rng.randint(8, 16)) for _ in range(60)] + [["x"] * 7, ["x"] * 300, [], list("abcd"), list("dcba")]
    # the same words in another order: word sets are equal, no shingle is
    words = say(80)
    texts += [words, words[::-1]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(texts[j]), "en", "src0", 0) for i, j in enumerate(order)]
    sets, near, far = [similarity.shingles(r[1].encode()) for r in rows], 0, 0
    for i in range(len(rows)):
        for j in range(i):
            share = jaccard(sets[i], sets[j])
            near, far = near + (0.8 <= share < 1), far + (0.6 <= share < 0.8)
            if share >= 0.8:
                a, b = (set(similarity._keys(similarity._digests(rows[x][1].encode())).tolist()) for x in (i, j))
                assert a & b
    assert near > 60 and far > 60
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "")
    assert {r.doc_id for r in got.collect()} == set(near_groups([r[1].encode() for r in rows]))


def test_pairs_of_a_hot_key_are_all_met():
    rng = np.random.default_rng(5)
    n = 700
    x = np.zeros((n, 4 + similarity.SKETCH), np.int64)
    x[:, 1], x[:, 2], x[:, 3] = np.sort(rng.integers(0, 40, n)), rng.permutation(n), rng.integers(50, 60, n)
    x[:, 4] = 1 << rng.integers(0, 8, n)
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array(c) for c in x[i : i + 100].T], [f"c{k}" for k in range(x.shape[1])]) for i in range(0, n, 100)]
    got = [r for b in similarity._crossed(batches()) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    cls = dict(x[:, [2, 1]].tolist())
    assert sorted(got) == sorted((a, b, cls[a], cls[b]) for a in range(n) for b in range(a) if cls[a] != cls[b])
    forest = [r for b in similarity._forest(batches()) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(forest) == len(set(cls.values())) - 1 and set(forest) <= set(got)


def test_rows_of_shared_keys_pass_batch_by_batch():
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 40), i) for i in range(200)) + [(99, 1), (100, 5), (100, 6)]
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "node"]) for i in range(0, len(rows), size)]
        got = sorted(r for b in similarity._shared(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        groups = collections.defaultdict(list)
        for k, n in rows:
            groups[k].append(n)
        assert got == sorted((k, n, min(ns)) for k, ns in groups.items() if len(ns) > 1 for n in ns)


def test_only_keys_of_several_classes_stay():
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 40), rng.randint(0, 1), i) for i in range(120)) + [(99, 1, 1), (100, 5, 5), (100, 5, 6)]
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "c", "node"]) for i in range(0, len(rows), size)]
        got = [r for b in similarity._contested(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [r for r in rows if len({c for k, c, _ in rows if k == r[0]}) > 1] and 0 < len(got) < len(rows)


def test_copies_leave_no_rows_for_the_keys_they_share(spark, monkeypatch):
    sizes, write = {}, similarity.Scratch.write

    def counted(self, df, what):
        out = write(self, df, what)
        sizes[what] = max(sizes.get(what, 0), out.count())
        return out

    monkeypatch.setattr(similarity.Scratch, "write", counted)
    texts = [" ".join(f"w{i}x{k}" for k in range(150)) + f" end{j}" for i in range(10) for j in range(6)]
    # a third that shares parts with each of a pair, without being similar to either
    texts += [" ".join(f"v{k}" for k in range(lo, lo + 100)) for lo in (0, 15, 45)]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, t binary").repartition(5)
    want = {i: g for i, g in enumerate(near_groups([t.encode() for t in texts])) if g != i}
    for rows in (similarity.OPEN_ROWS, 3):
        monkeypatch.setattr(similarity, "OPEN_ROWS", rows)
        assert {r.a: r.b for r in similarity.similar_classes(df).collect()} == want
    assert max(sizes.values()) <= 5 * len(texts), sizes
    label = spark.createDataFrame([(1, 0)], "a long, b long")
    for most in (0, 5):
        assert {(r.node, r.c) for r in similarity._classed(df, label, most).collect()} == {(i, 0 if i == 1 else i) for i in range(len(texts))}


def test_near_copies_neither_copy_nor_shuffle_the_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, what: written.append((what, df.columns)) or materialize(df, what))
    text = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    rows = [(i, text[i % 9] + (" end" if i > 8 else ""), "en", "src0", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(9))
    assert not [what for what, columns in written if "text" in columns]
    ids = spark.createDataFrame([(3,), (5,)], "doc_id long")
    for most in (0, 2):
        assert sorted(r.doc_id for r in chosen(docs, ids, most=most).collect()) == [3, 5]
        assert sorted(r.doc_id for r in chosen(docs, ids, "left_anti", most).collect()) == [i for i in range(12) if i not in (3, 5)]
    assert "BroadcastHashJoin" in chosen(docs, ids)._jdf.queryExecution().executedPlan().toString()
    # ids that repeat or lack don't name rows
    odd = spark.createDataFrame([(None if i % 5 == 0 else 1, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    assert corpus_pipeline.near_copies(spark, odd, "").count() == 9 and [what for what, columns in written if "text" in columns] == ["near-rows"]
