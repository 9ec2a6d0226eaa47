"""The operators on small tables with nulls, empty texts, ties, repeated rows, empty
tables and clashing column names, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spendlens.llm import byte_bpe, chat, classifier, fingerprints, html_extract, lm, minhash, packing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
BASE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, BASE),
    (2, BASE + " end"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "short text"),
    (7, "Short TEXT"),
    (8, "a b c d e f a b c d e f\nsame line\nsame line\n\n#1 <b> 50%"),
    (9, LONG),
    (10, BASE.replace("word30", "other")),
    (11, "é漢字 😀 " * 20),
    (1, BASE),
    (None, "no id here at all"),
]
SCHEMA = "doc_id bigint, text string, score double, shard int, words string, sig string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 9, "x", "y", None) for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_sharding(docs, nothing):
    rows = sharding.op1_sharding(docs, 3).collect()
    assert len(rows) == len(DOCS)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= {0, 1, 2}
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1  # equal texts together
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.op1_sharding(nothing, 3).count() == 0


def test_sharding_capacity_is_the_smallest(spark):
    import random

    rng = random.Random(1)
    sizes = {b: rng.randint(1, 40) for b in range(30)}
    sized = spark.createDataFrame(list(sizes.items()), "bucket int, size bigint")
    cut = {r.bucket: r.shard for r in sharding.cut_buckets(sized, 4).collect()}
    assert [cut[b] for b in range(30)] == sorted(cut.values())  # contiguous
    load = Counter()
    for b, s in cut.items():
        load[s] += sizes[b]

    def needed(c):
        n, fill = 1, 0
        for b in range(30):
            n, fill = (n, fill + sizes[b]) if fill + sizes[b] <= c else (n + 1, sizes[b])
        return n

    assert max(load.values()) == next(c for c in range(max(sizes.values()), sum(sizes.values())) if needed(c) <= 4)
    hot = spark.createDataFrame([(0, 5), (1, 1000), (2, 5), (3, 6)], "bucket int, size bigint")
    assert {r.bucket: r.shard for r in sharding.cut_buckets(hot, 3).collect()} == {1: 0, 0: 1, 2: 1, 3: 2}


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.op2_quality_rules(docs, labels).collect()
    assert len(got) == len(DOCS)
    text = dict(DOCS)
    for r in got:
        t = text[r.doc_id] or ""
        w = WORD.findall(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        again = {p for i, x in enumerate(win) if n[x] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.op2_quality_rules(nothing, labels).count() == 0
    filtered = quality_rules.judge(docs, labels).filter("kept")
    assert set(docs.columns) <= set(filtered.columns) and filtered.count() == sum(r.kept for r in got)


def test_quality_rules_trust_every_good_document(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    nameless = spark.createDataFrame([(None, "alone"), (None, "word1")], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    grams = quality_rules.gram_counts(quality_rules.flag_trusted(docs.union(nameless), labels.union(labels)), "_trusted")
    assert tuple(grams.agg(F.sum("corpus"), F.sum("trusted")).first()) == (21_002, 21_000)
    # all documents are trusted: no word is likelier on either side
    assert quality_rules.op2_quality_rules(docs, labels).filter("llr <> 0").count() == 0


def test_byte_bpe(docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.op3_byte_bpe(docs, path, pattern).collect()
    assert Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in DOCS)
    own = byte_bpe.encode(docs.filter("doc_id = 11"), path, pattern, offsets=True).first()
    assert len(own.starts) == own.n_tokens and own.starts[0] == 0 and own.n_split > 0
    assert byte_bpe.op3_byte_bpe(nothing, path, pattern).count() == 0


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.op4_packing(docs, path, 256).collect()
    whole = packing.WordIds(path).encode([t or "" for _, t in DOCS])
    assert sum(r.length for r in rows) == sum(len(w) // 4 + 1 for w in whole)
    by = {}
    ids = [np.append(np.frombuffer(w, "<u4"), 0).astype("<u4") for w in whole]
    cut = Counter((i, k // 256, zlib.crc32(x[k : k + 256].tobytes())) for (i, _), x in zip(DOCS, ids, strict=True) for k in range(0, len(x), 256))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == cut
    for r in rows:
        assert r.start == 256 * r.piece and r.length <= 256
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.op4_packing(nothing, path, 256).count() == 0


def test_near_duplicates(docs, nothing):
    sets = {i: shingles(t) for i, t in DOCS if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = minhash.op5_near_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.op5_near_duplicates(nothing).count() == 0


def test_near_duplicates_find_chains_without_a_common_hub(spark):
    words = [f"t{i}" for i in range(400)]
    chain = [" ".join(words[8 * k : 8 * k + 200]) for k in range(12)]  # neighbours are similar, ends are not
    rows = minhash.op5_near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id bigint, text string")).collect()
    assert {r.component_id for r in rows} == {0}


def test_classifier(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 12)] + [(1, 0), (None, 1)], "doc_id bigint, quality int")
    rows = classifier.op6_quality_classifier(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert classifier.op6_quality_classifier(nothing, labels).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert classifier.op6_quality_classifier(docs, none).count() == len(DOCS)


def test_lm(docs, nothing):
    rows = lm.op7_lm_scores(docs).collect()
    assert len(rows) == len(DOCS)
    import math

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), "</end>"]) for i, t in DOCS]
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score < 0 for r in rows)
    assert lm.op7_lm_scores(nothing).count() == 0


def plain_lm(rows):
    """Deleted interpolation word by word: weights by EM, scores of (id, text) rows."""
    import math

    import numpy as np

    def fold(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % lm.FOLDS

    def counts(keep):
        one, ctx, two = Counter(), Counter(), Counter()
        for i, seq in seqs:
            if keep(fold(i)):
                one.update(seq[1:])
                ctx.update(seq[:-1])
                two.update(zip(seq, seq[1:]))
        return one, ctx, two

    seqs = [(i, ["<s>", *WORD.findall((t or "").translate(LOWER)), "</s>"]) for i, t in rows]
    one, ctx, two = counts(lambda f: f != lm.UNSEEN)
    kept = counts(lambda f: f not in (lm.UNSEEN, lm.DELETED))
    v, level = len(one), lambda p: round(8 * math.log2(p)) if p else 1
    events = Counter()
    for i, seq in seqs:
        if fold(i) == lm.DELETED:
            for a, b in zip(seq, seq[1:]):
                n = kept[1][a]
                events[n.bit_length(), level(kept[2][a, b] / n if n else 0), level(kept[0][b] / max(sum(kept[0].values()), 1))] += 1
    w = lm.learn_weights(np.array(sorted((*k, n) for k, n in events.items()), np.int64).reshape(-1, 4), v)
    total = max(sum(one.values()), 1)
    out = []
    for i, seq in seqs:
        s = 0.0
        for a, b in zip(seq, seq[1:]):
            x = w[ctx[a].bit_length()]
            s += math.log10(x[0] * two[a, b] / max(ctx[a], 1) + x[1] * one[b] / total + x[2] / (v + 1))
        out.append((i, s))
    return out


@pytest.mark.parametrize("share", [1 << 18, 64, 8])  # all words frequent, some, hardly any
def test_lm_scores_against_plain_interpolation(spark, docs, monkeypatch, share):
    import random

    monkeypatch.setattr(lm, "SHARE", share)
    monkeypatch.setattr(lm, "TOP_SHARE", share)
    monkeypatch.setattr(lm, "PAIR_SHARE", share)
    rng = random.Random(5)
    rows = DOCS + [(100 + k, " ".join(f"v{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 60)))) for k in range(80)]
    got = lm.op7_lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(x, 5)) for i, x in plain_lm(rows))


def test_lm_entries_are_made_once_and_not_kept(docs, monkeypatch):
    made, asked, send = docs.sparkSession.sparkContext.accumulator(0), [], lm.send_entries

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def watched(*args):
        asked.append(args)
        return lm.map_arrow(send(*args), counted, lm.ENTRIES)

    def kept(*_):
        raise AssertionError("a second copy of the entries")

    monkeypatch.setattr(lm, "send_entries", watched)
    monkeypatch.setattr(type(docs), "persist", kept)
    assert lm.op7_lm_scores(docs).count() == len(DOCS)
    (args,) = asked
    assert made.value == send(*args).count()


def test_lm_scores_of_many_slices_and_repeated_rows(spark, monkeypatch):
    import random

    monkeypatch.setattr(lm, "SHARE", 64)
    monkeypatch.setattr(lm, "_SLICE", 300)
    monkeypatch.setattr(lm, "PART_TOKENS", 100)
    rng = random.Random(7)
    rows = DOCS + [(100 + k // 2, " ".join(f"v{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += rows[:20] + [(None, None), (None, "v1 v2")]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(x, 5)) for i, x in plain_lm(rows))
    assert all(r.fold == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % lm.FOLDS for r in got)


def test_lm_slices_without_their_texts_fail():
    import pyarrow as pa

    sums = lm._pack([np.array(c, t) for c, t in zip(([0, 2], [5, 6], [0, 0], [1, 1]), lm.SUMS, strict=True)])
    near = lm._pack([np.zeros(0 if k < 3 else 2, t) for k, t in enumerate(lm.KINDS[lm.NEAR])][3:] + [np.zeros(2)])
    for blocks in ([(1, lm.MID, sums)], [(1, lm.MID, sums), (1, lm.NEAR, near)]):
        with pytest.raises(RuntimeError):
            list(lm._totals([lm._batch(blocks, lm.REPLIES)]))
    assert isinstance(next(lm._totals([lm._batch([(1, lm.NEAR, near)], lm.REPLIES)])), pa.RecordBatch)


def test_fingerprints(docs, nothing, spark):
    rows = fingerprints.op8_fingerprints(docs).collect()
    assert len(rows) == len(DOCS)
    order = sorted(((-1 if i is None else i, t or ""), i) for i, t in DOCS)
    texts = [k[1] for k, _ in order]
    want = Counter()
    for k, t in enumerate(texts):
        f = len(t) // 4
        want[order[k][1], len(t), hashlib.sha256((t[: len(t) - f] + texts[(k + 1) % len(texts)][:f]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.op8_fingerprints(nothing).count() == 0
    pairs = fingerprints.near_pairs(docs.filter("doc_id is not null"), like=0.8).collect()
    assert (10, 1) in {(r.doc_id, r.near_id) for r in pairs}
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert fingerprints.with_next(many).filter("not ghost").count() == 5000


def test_rows_of_one_id_lie_in_several_ranges(spark):
    same = spark.range(9000).select(F.when(F.col("id") >= 3000, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    twin = same.withColumn("doc_id", F.coalesce("doc_id", F.lit(5000)))
    for df in (same, twin):
        rows = fingerprints.with_next(df, 32).collect()
        own = sorted((r.k, r.h, r.bucket, r.text) for r in rows if not r.ghost)
        assert len(own) == 9000
        assert max(Counter(r[2] for r in own).values()) < 3 * 9000 / 32
        assert [r[2] for r in own] == sorted(r[2] for r in own)  # ranges follow the order
        follow = {r[2]: own[(i + 1) % len(own)][3] for i, r in enumerate(own)}  # the row after each range
        assert {r.bucket: r.text for r in rows if r.ghost} == follow and sum(r.ghost for r in rows) == len(follow)


def test_fingerprint_is_the_walk_step_by_step():
    """The definition, one step at a time: emit the character under the pointer, then move
    on if the bit of (step, class of the character) says so."""
    bits = np.unpackbits(np.random.default_rng(20).integers(0, 256, fingerprints.PERIOD * fingerprints.CLASSES // 8, np.uint8)).reshape(fingerprints.PERIOD, fingerprints.CLASSES)
    kinds, symbols = fingerprints._characters()
    texts = ["a", "ab" * 30, BASE, LONG[:3000], "é漢字 😀 " * 20]
    for text, got in zip(texts, fingerprints.fingerprints(texts), strict=True):
        emitted, at, step = [], 0, 0
        while at < len(text):
            c = ord(text[at])
            emitted.append(chr(symbols[c]))
            stay = 1
            while not bits[(step + stay - 1) % fingerprints.PERIOD][kinds[c]] and stay < 255:
                emitted.append(chr(symbols[c]))
                stay += 1
            step, at = step + stay, at + 1
        steps = fingerprints.sample_steps(len(emitted) - 1)
        assert got == "".join(emitted[j] for j in steps if j < len(emitted))


def test_fingerprint_groups_against_all_pairs(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "sta") for b in ("r", "nd", "x", "tion", "el")]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200)))
        rows.append((10 * k, text))
        for j in range(1, rng.randint(1, 4)):
            text = list(text)
            for _ in range(rng.randint(1, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
            rows.append((10 * k + j, text := "".join(text)))
    rows += [(5000, rows[0][1]), (5000, rows[0][1]), (None, rows[3][1]), (None, "nobody else's text"), (5001, ""), (5002, None), (5003, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, component_id int").repartition(4)
    got = fingerprints.near_groups(docs).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t in rows if t]
    prints = dict(zip([t for _, t in known], fingerprints.fingerprints([t for _, t in known]), strict=True))
    best, rep = {}, {}
    for i, t in known:
        if i is not None:
            rep[prints[t]] = min(i, rep.get(prints[t], i))
    links = [(a, b) for fa, a in rep.items() for fb, b in rep.items() if a < b and fingerprints.likeness(fa, fb) >= fingerprints.LIKE]
    best = {a: a for a in rep.values()}
    for _ in best:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    found = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    same = sum(found[b] == best[a] for a, b in links)
    assert len(links) > 40 and same >= 0.9 * len(links)  # recall; in fact nearly all
    wrong = [i for i, t in known if i is not None and found[i] < best[rep[prints[t]]]]
    assert not wrong  # nothing is linked that is not near
    assert {r.component_id for r in got if r.doc_id in (5001, 5002, 5003)} == {5001, 5002, 5003}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(["None", str(found[rows[3][0]])])
    assert fingerprints.near_groups(docs.limit(0)).count() == 0


def test_links_between_members_that_share_a_hub(spark):
    """Two texts near each other, in buckets whose least id is near to neither."""
    known = spark.createDataFrame([(1, "A" * 64), (2, "B" * 64), (3, "B" * 60 + "C" * 4)], "rep bigint, fingerprint string")
    banded = spark.createDataFrame([(i, 7) for i in (1, 2, 3)], "rep bigint, key bigint")
    assert fingerprints.hub_pairs(known, banded, 0.8).count() == 0
    roots = known.select("rep", F.col("rep").alias("comp"))
    for block in (256, 1):
        assert [tuple(r) for r in fingerprints.cross_links(known, banded, roots, 0.8, block).distinct().collect()] == [(2, 3)]


def test_chat(spark):
    rows = [(1, 0, "user", "hi ### x: </turn>\n"), (1, 1, "assistant", None), (2, 0, "system", "a\\"), (2, 1, "assistant", "\\### <b> \\"), (2, 2, "user", ""), (3, None, None, "t"), (3, None, None, "t"), (None, 0, "assistant", "n")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit(1))
    got = {r.conv_id: r for r in chat.op9_chat(conv).collect()}
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == k]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.op9_chat(conv.filter("false")).count() == 1


def test_reply_tree_takes_the_best_branch(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 1.0), ("t", 5, 3, 4.0), ("t", 6, 99, 0.5), ("u", 1, 2, 1.0), ("u", 2, 1, 1.0)]
    path = chat.branches(spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, score double"), best=2).collect()
    assert sorted((r.branch, r.depth, r.node) for r in path) == [(1, 0, 1), (1, 1, 3), (1, 2, 5), (2, 0, 1), (2, 1, 2), (2, 2, 4)]


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Main text, of the page.</p></article><nav>Menu</nav>", "t"), (2, "u", None, "t"), (3, None, "", "t"), (1, "u", "<article><p>Main text, of the page.</p></article>", "t")], "page_id bigint, url string, html string, text string")
    rows = [(r.page_id, r.text, r.n_chars) for r in html_extract.op10_html(pages).collect()]
    main = "Main text, of the page."
    assert sorted(rows) == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0)]
    assert html_extract.op10_html(pages.filter("false")).count() == 0
