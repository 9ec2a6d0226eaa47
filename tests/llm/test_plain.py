"""The operators' core functions against plain statements of what they compute."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spendlens.llm import byte_bpe, chat, classifier, common, fingerprints, html_extract, lm, minhash, packing

ODD = ["", " ", "a", "Hello  world\n\n x", "don't I'LL 50% 漢字 😀é b", "x" * 5000, "\u0085a\x1cb", "é Σς", "\\### </turn>", None]


def test_words_and_shingles():
    texts = ["A b a", "", " \t", "one two three four five six", None, "b"]
    h, n = common.word_hashes(*common.utf8(pa.array(texts)), lower=True)
    assert n.tolist() == [3, 0, 0, 6, 0, 1]
    assert h[0] == h[2] and h[1] == h[9] and len(set(h.tolist())) == 8
    s, k = common.shingle_hashes(h, n, 5)
    assert k.tolist() == [1, 0, 0, 2, 0, 1]


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["w%d ü%d" % (i % 7, i) for i in range(50)]
    whole, _ = common.word_hashes(*common.utf8(pa.array(texts)), lower=False)
    parts = [common.word_hashes(*common.utf8(pa.array(texts).slice(i, 7)), lower=False)[0] for i in range(0, 50, 7)]
    assert np.array_equal(whole, np.concatenate(parts))


def test_byte_bpe_equals_tiktoken_and_round_trips():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    mine = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(chr(rng.choice([32, 10, 9, 65, 0x61, 0xE9, 0x301, 0x2003, 0x4E2D, 0x1F600, 0x85, 0x27, 0x73, 0x31])) for _ in range(60)) for _ in range(200)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_packing_tokens_equal_the_library():
    mine = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for t in ODD if t is not None] + ["The cat, sat; on İstanbul's MAT. <|endoftext|> naïve1"]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_packing_solution_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    counts = np.zeros(capacity + 1, np.int64)
    for length in rng.choice([rng.integers(1, capacity), rng.integers(20, 40)], 1) if seed == 3 else rng.integers(1, capacity, 40):
        counts[length] += rng.integers(1, 30)
    plan = packing.solve(counts, capacity, groups=16)
    room, seen = {}, np.zeros(capacity + 1, np.int64)
    for r in plan.itertuples():
        assert r.first == seen[r.length]
        seen[r.length] += r.count
        for i in range(r.count):
            room.setdefault(r.sequence + i // r.each, []).append((r.offset + r.length * (i % r.each), r.length))
    assert np.array_equal(seen, counts)
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    left = []  # best fit, longest first, piece by piece
    for length in np.repeat(np.arange(capacity + 1), counts)[::-1].tolist():
        fit = min((r for r in left if r >= length), default=None)
        if fit is not None:
            left.remove(fit)
        left.append((capacity if fit is None else fit) - length)
    assert len(room) <= len(left) * 1.05 + 2


def test_packing_no_pieces():
    assert len(packing.solve(np.zeros(65, np.int64), 64)) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in itertools.product((30, 400), (0.5, 0.9)):
        both = round(2 * n * share / (1 + share))
        est = []
        for _ in range(12):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            b[both:] = rng.integers(0, 1 << 63, n - both).astype(np.uint64)
            s = minhash.signatures(np.concatenate([a, b]), np.array([n, n]))
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - share) < 0.05
    assert not minhash.signatures(np.zeros(0, np.uint64), np.array([0])).any()


def test_classifier_learns_and_rejects_empty_texts():
    rng = random.Random(5)
    good = [" ".join(rng.choice(["river", "stone", "green", "walks", "the"]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "win$$$", "click***"]) for _ in range(40)) for _ in range(120)]
    texts, y = good[:90] + bad[:90] + [""], np.array([1] * 90 + [0] * 91)
    w = classifier.train(classifier.bags(*common.utf8(pa.array(texts))), y)
    ids, owner = classifier.feature_ids(*common.utf8(pa.array(good[90:] + bad[90:] + [""])))
    score = np.bincount(owner, w[ids]) / np.bincount(owner)
    assert (score[:30] > 0).all() and (score[30:] < 0).all()


def test_classifier_features_are_words_repeats_and_ngrams():
    """Features listed in plain Python and buckets (so many that none is shared) have the
    same counts over the texts."""
    texts = ["the river the river", "a a a", "", "ab", " \n", "x", "é漢 river", "go go!! go go", "   "]
    ids, owner = classifier.feature_ids(*common.utf8(pa.array(texts)), bits=40)
    told = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        words = raw.split()
        own = [("word", w) for w in words] + ["again"] * sum(a == b for a, b in itertools.pairwise(words))
        own += [("ngram", raw[i : i + n]) for n in classifier.NGRAMS for i in range(len(raw) - n + 1)]
        for feature in own or ["empty"]:
            told.setdefault(feature, [0] * len(texts))[k] += 1
    found = {}
    for bucket, k in zip(ids.tolist(), owner.tolist(), strict=True):
        found.setdefault(bucket, [0] * len(texts))[k] += 1
    assert sorted(found.values()) == sorted(told.values())
    assert found[classifier.EMPTY] == told["empty"] and found[classifier.AGAIN] == told["again"]


def test_classifier_training_step_by_step():
    """The same descent on the softmax loss, one number at a time."""
    rng = random.Random(3)
    bits, docs, y = 5, [], []
    for _ in range(12):
        buckets = sorted(rng.sample(range(1 << bits), 4))
        n = [rng.randint(1, 5) for _ in buckets]
        docs.append((np.array(buckets), np.array(n) / sum(n)))
        y.append(rng.randint(0, 1) if len(y) > 1 else len(y))
    got = classifier.train(docs, np.array(y), bits)
    order, dim = np.random.default_rng(1), classifier.DIM
    vector = order.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).tolist()
    out = [[0.0] * dim, [0.0] * dim]
    step = 0
    for _ in range(classifier.EPOCHS):
        for k in order.permutation(len(docs)):
            rate = classifier.RATE * (1 - step / (classifier.EPOCHS * len(docs)))
            step += 1
            mean = [sum(s * vector[b][d] for b, s in zip(*docs[k])) for d in range(dim)]
            odds = [math.exp(sum(o * m for o, m in zip(out[c], mean))) for c in (0, 1)]
            error = [(odds[c] / sum(odds) - (c == y[k])) * len(y) / (2 * y.count(y[k])) for c in (0, 1)]
            back = [sum(error[c] * out[c][d] for c in (0, 1)) for d in range(dim)]
            for c in (0, 1):
                out[c] = [o - rate * 0.01 * error[c] * m for o, m in zip(out[c], mean)]
            for b, s in zip(*docs[k]):
                vector[b] = [v - rate * s * x for v, x in zip(vector[b], back)]
    want = [sum(v * (p - q) for v, p, q in zip(row, out[1], out[0])) for row in vector]
    assert np.abs(got).max() > 0.01 and np.allclose(got, want, atol=1e-3, rtol=1e-2)


def test_lm_weights_are_shares():
    events = np.array([[3, -8, -40, 50], [3, 1, -40, 10], [0, 1, -30, 5], [0, 1, 1, 2]])
    w = lm.learn_weights(events, 1000)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all() and w[0, 0] == 0


def test_fingerprints():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ijklmnop\n") for _ in range(3000))
    near = text[:700] + "z" + text[701:1500] + text[1501:]  # a replacement and a deletion
    far = "".join(rng.choice("abcdefgh ijklmnop\n") for _ in range(3000))
    a, b, c, again, empty = fingerprints.fingerprints([text, near, far, text, ""])
    assert a == again and empty == ""
    assert fingerprints.likeness(a, b) > 0.8 > 0.3 > fingerprints.likeness(a, c)
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness(a, "") == 0.0


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.choice([-2, -1, -0.5, 0.5, 1, 2.5]) for _ in range(n)]
        tied = {(i, j): rng.choice([0.25, 0.75, 1.5]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(x):
            return sum(max(0, -o) if a else max(0, o) for o, a in zip(odds, x, strict=True)) + sum(c for (i, j), c in tied.items() if x[i] != x[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_extract.minimum_cut(odds, tied)) == pytest.approx(best)


def test_main_text():
    w = html_extract.PRIOR
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<article><h1>A &amp; B</h1><p>First  paragraph,<br>of &lt;b&gt; text.</p><p>No.</p><div class='ad'>Buy, now, this.</div><p>Last&nbsp;one.</article>"
        "<section id=comments><p>I liked this text, a lot.</p></section><aside><p>Related, long, text here.</p></aside><footer>&copy; x</footer>"
    )
    assert html_extract.main_text(page, w) == "A & B\nFirst paragraph, of <b> text.\nNo.\nLast one."
    assert html_extract.main_text(None, w) == html_extract.main_text("", w) == html_extract.main_text("<nav>x</nav>", w) == ""
    assert html_extract.main_text("<article><p>Cut off here, in a tag.</p><p cla", w) == "Cut off here, in a tag."
    plain = "<body><div id=sidebar><p>One, two, three and so on.</p></div><div class=post><p>A long sentence, with commas, stands here.</p><p>Short.</p></div></body>"
    assert html_extract.main_text(plain, w) == "A long sentence, with commas, stands here.\nShort."


def test_main_text_without_the_end_of_the_head():
    body = "<article><p>The whole text, of this page.</p></article><nav>Menu</nav>"
    for head in ("<meta charset=utf-8><title>T</title>", "<title>T <b>x</b></title><script>var a;</script>", "<noscript><img src=x><p>No script.</p></noscript><title>T</title>", "<title>T"):
        for page in (f"<html><head>{head}<body>{body}</body></html>", f"<head>{head}{body}", f"<html><head>{head}</head><body>{body}"):
            assert html_extract.main_text(page, html_extract.PRIOR) == "The whole text, of this page.", page
    assert html_extract.main_text("<head><title>T</title>A bare text, of one long sentence.", html_extract.PRIOR) == "A bare text, of one long sentence."


def test_main_text_in_layouts_named_after_their_sidebar():
    prose = "<p>A first sentence of the article, with commas.</p><p>A second sentence, which is as long.</p>"
    want = "A first sentence of the article, with commas.\nA second sentence, which is as long."
    side = "<div class=sidebar><article><p>A teaser, of another one.</p></article></div>"
    for page in (
        f'<div class="content-sidebar-wrap"><article>{prose}</article></div>{side}',
        f'<div class="has-sidebar"><main>{prose}</main>{side}</div>',
        f'<form><div class="sidebar-layout"><main class="widget">{prose}</main></div></form>',
        f'<div class="sidebar-layout"><form><article>{prose}</article></form></div>',
        f'<div class="no-sidebar"><p class=x>{prose}</div>',
    ):
        assert html_extract.main_text(page, html_extract.PRIOR) == want, page
    page = f'<article>{prose}<section id="discussion"><p>The findings, as said, agree.</p></section><div class=share><p>Share this, now.</p></div><section class="comments reply"><p>I liked it, a lot.</p></section></article>'
    assert html_extract.main_text(page, html_extract.PRIOR) == want + "\nThe findings, as said, agree."


def test_chat_escapes_are_one_to_one():
    assert re.search(r"\\#", chat.TURN_END) is None


@pytest.mark.parametrize("name", ["comments", "related", "newsletter", "share", "advert", "comment", "sidebar"])
def test_sections_of_forbidden_kinds_go(name):
    prose = "".join(f"<p>The main text goes on, as it does, in sentence {i} of this article.</p>" for i in range(6))
    page = f'<html><body><article>{prose}<section id="{name}"><p>I liked this text, a lot, as I said before.</p></section></article></body></html>'
    text = html_extract.main_text(page, html_extract.PRIOR)
    assert "sentence 5" in text and "liked" not in text


def test_formulas_stay():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b in TeX</annotation></math> is what we look for, as said.</p></article>"
    text = html_extract.main_text(page, html_extract.PRIOR)
    assert "a+b is what we look for" in text and "TeX" not in text
