"""Classifiers, language model, extraction and decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, prose
from pyspark.sql import functions as F

from finwake.llm import decontamination, html_text, lm_scoring, quality, toxicity
from finwake.llm import textops as X
from finwake.llm.labelled import training_rows

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    s, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    return auc, np.mean(np.array([r.predicted for r in rows]) == y)


def test_quality_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.decisions(docs, labels)
    assert out.count() == docs.count()
    auc, accuracy = held_out(spark, out, "quality")
    assert auc > 0.98 and accuracy > 0.97


def test_toxicity_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    auc, accuracy = held_out(spark, toxicity.decisions(docs, labels), "toxic")
    assert auc > 0.9 and accuracy > 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_odd_rows(spark, frame, module, label):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.filter("false")):
        rows = module.decisions(frame(ODD), known).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ODD if i is not None}
    assert module.decisions(frame([]), labels).count() == 0


def test_a_labelled_id_that_repeats_gives_one_training_row(spark, frame):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:20]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id bigint, quality int, toxic int")
    plain = frame([(i, prose(20, i)) for i in ids])
    hot = spark.range(100_000).select(F.lit(ids[0]).alias("doc_id"), F.concat(F.lit("~ later "), F.col("id").cast("string")).alias("text"))
    docs = plain.select("doc_id", "text").unionByName(hot)
    rows = training_rows(docs, labels, "quality", 50).collect()
    assert sorted(r._k for r in rows) == ids and all(r._text == prose(20, r._k) for r in rows)
    for module in (quality, toxicity):
        scores = module.decisions(docs, labels).join(plain.select("doc_id").distinct(), "doc_id")
        got = {r.doc_id: r.score for r in scores.filter(f"doc_id != {ids[0]}").collect()}
        want = {r.doc_id: r.score for r in module.decisions(plain, labels).filter(f"doc_id != {ids[0]}").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quality_is_fitted_on_every_training_document(spark, tmp_path):
    bad = [[float(i % 7)] + [0.0] * 21 for i in range(900)]
    good = [[float(i % 5)] + [1.0] * 21 for i in range(5000)]
    rows = [(i, y, x) for i, (y, x) in enumerate([(0, x) for x in bad] + [(1, x) for x in good])]
    train = spark.createDataFrame(rows, "_k bigint, _y int, x array<float>")
    places = quality.numbered(train, len(rows)).select("_y", "_i").collect()
    assert sorted((r._y, r._i) for r in places) == [(0, i) for i in range(900)] + [(1, i) for i in range(5000)]
    marked = train.withColumn("x", F.array(F.col("_k").cast("float")))
    drawn = quality.preferences(marked, {0: 900, 1: 5000}, pairs=1).collect()
    assert len(drawn) == quality.MEETINGS * 5000 == len({(r.good[0], r.bad[0]) for r in drawn})
    assert len({r.good[0] for r in drawn}) == 5000 and len({r.bad[0] for r in drawn}) == 900
    model = quality.fit(train)
    assert model["counts"] == {0: 900, 1: 5000} and abs(model["centre"][1] - 5000 / 5900) < 1e-9


def test_quality_threshold_is_exact(spark):
    rng = np.random.default_rng(3)
    for n_good, n_bad, share, place in ((6000, 5000, 0.3, 2), (50, 40, 0.5, 0), (5000, 1, 0.2, 3)):
        good, bad = rng.normal(2, 1, n_good).round(place), rng.normal(0, 1, n_bad).round(place)
        scores = spark.createDataFrame([(1, float(v)) for v in good] + [(0, float(v)) for v in bad], "_y int, v double")
        cut, unit = quality.threshold(scores, {1: n_good, 0: n_bad}, share)
        below = lambda t: (good < t).mean() * (1 - share) + (bad < t).mean() * share
        values = np.unique(np.concatenate([good, bad]))
        best = min(abs(below(t) - share) for t in (values[1:] + values[:-1]) / 2)
        assert abs(abs(below(cut) - share) - best) < 1e-9
        assert abs(unit - np.concatenate([good, bad]).std() / 2) < 1e-9
    one = spark.createDataFrame([(1, 4.0), (0, 4.0)], "_y int, v double")
    assert quality.threshold(one, {1: 1, 0: 1}, 0.5) == (4.0, 1e-6)


def test_quality_features_follow_the_text():
    x = quality.text_features(pa.array(["AB cd", "", "a a a b"]))
    f = dict(zip(quality.NAMES, x.T))
    assert f["upper"].tolist() == [0.4, 0, 0] and f["top_word"].tolist() == [0.5, 0, 0.75]
    assert f["distinct_words"].tolist() == [1, 0, 0.5] and f["repeat_next"].tolist() == [0, 0, 0.5]
    assert not x[1].any()


def brute_lm(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    one, two, three = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = [None] + words(t)
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    bars = [{k: (x, y) for k, x, y in lm_scoring.histogram(np.array(list(c.values()), np.int64))} for c in (one, two, three)]
    weights = [lm_scoring.backoff(bars[k + 1], bars[k]) for k in (0, 1)]
    arcs = {(): one} | {1: two, 2: three}

    def step(state, w):
        """log10 weight from a state, by failure arcs down to the root."""
        if not state:
            return math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1)))
        seen = one[state[0]] if len(state) == 1 else two[state]
        d, power = weights[len(state) - 1]
        fail, arc = d * seen**power, arcs[len(state)][(*state, w)]
        below = step(state[1:] if one[state[-1]] else (), w)
        return math.log10((1 - fail) * arc / seen + fail * 10**below) if arc else math.log10(fail) + below

    out = []
    for i, t in rows:
        w, score, state = words(t), 0.0, (None,) if one[None] else ()
        for k, x in enumerate(w):
            score += step(state, x)
            last = (w[k - 1] if k else None, x)
            state = last if two[last] else (x,) if one[x] else ()
        base = sum(step((), x) for x in w)
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD, [(i, prose(30 + i, i % 9)) for i in range(60)], [(i, prose(40, i) + " " + prose(20, i % 5)) for i in range(40)], [(2, "a b")] * 9, []])
def test_language_model(frame, rows):
    got = lm_scoring.score_texts(frame(rows), block_bytes=1000).collect()
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got], key=str) == brute_lm(rows)


def test_long_texts_are_walked_in_pieces(frame):
    """Texts about as long as a piece, and far longer ones, score as in one walk."""
    near = [(60 + k, prose(lm_scoring.PIECE + k, k)) for k in range(-3, 3)]
    rows = [(i, prose(7 * i, i % 4)) for i in range(30)] + near + [(50, prose(5 * lm_scoring.PIECE, 77))]
    got = lm_scoring.score_texts(frame(rows), block_bytes=1000).collect()
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got], key=str) == brute_lm(rows)


def test_pieces_reach_the_state_of_the_whole_walk():
    rng = np.random.default_rng(4)
    tokens, sizes = rng.integers(0, 6, 400), np.array([1, 2, 3, 4, 5, 85, 100, 200])
    begins = np.cumsum(sizes) - sizes
    numbers = []
    for k in range(3):
        key = [tuple(tokens[max(i - k, 0) : i + 1]) for i in range(400)]
        names = {x: j for j, x in enumerate(dict.fromkeys(key))}
        numbers.append(np.array([names[x] for x in key], np.int32))
    numbers[2][begins] = -1
    where = [np.array([np.flatnonzero(n == j)[0] if (n == j).any() else 1 for j in range(n.max() + 1)]) for n in numbers]
    counts = [rng.integers(0, 3, n.max() + 1) * 40 // 3**k for k, n in enumerate(numbers)]
    lower = [numbers[k][where[k + 1]] for k in (0, 1)]
    sources = [numbers[k][where[k + 1] - 1] for k in (0, 1)]
    counts[1] = np.where(counts[0][lower[0]] * counts[0][sources[0]] > 0, np.minimum(counts[1], counts[0][sources[0]]), 0)
    counts[2] = np.where(counts[1][lower[1]] * counts[1][sources[1]] > 0, np.minimum(counts[2], counts[1][sources[1]]), 0)
    m = lm_scoring.Automaton(counts, sources, lower, 1000, 6, ((0.5, -0.3), (0.6, -0.2)))
    whole = m.walk(numbers, begins, sizes, 0, 1000)
    for piece in (2, 3, 7, 64):
        assert np.allclose(m.walk(numbers, begins, sizes, 0, piece), whole, atol=1e-9)
    assert (whole < 0).all()


def test_counts_survive_packing():
    for counts in ([], [0, 1, 254], [255, 70_000, 3, 1 << 40], [300] * 5):
        c = np.array(counts, np.int64)
        assert lm_scoring._wide(lm_scoring._narrow(c)).tolist() == counts
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring._unpack(lm_scoring._pack(keys)) == keys).all()


def test_extraction_on_unseen_layouts():
    model = html_text.default_model()
    wrong = total = 0
    for blocks, y in html_text.labelled_pages(120, seed=77):
        wrong += sum(a != b for a, b in zip(model.label(blocks), y))
        total += len(y)
    assert wrong / total < 0.01


def test_blocks():
    page = "<p>a&amp;b <b>c<br>d</b>  e<p>f<ul><li>g<li><a href=x>h</a></ul><script>no</script><div hidden>i</div>tail<di"
    assert [b.text for b in html_text.blocks_of(page)] == ["a&b c d e", "f", "g", "h", "i", "tail"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("plain &lt; text")[0].text == "plain < text"


def test_viterbi_finds_the_best_sequence():
    r = random.Random(1)
    for n in range(1, 8):
        emit = [(r.uniform(-2, 2), r.uniform(-2, 2)) for _ in range(n)]
        trans, start = [[r.uniform(-2, 2) for _ in "ab"] for _ in "ab"], [0.3, -0.2]
        value = lambda y: start[y[0]] + sum(emit[i][k] for i, k in enumerate(y)) + sum(trans[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert value(html_text.viterbi(emit, trans, start)) == pytest.approx(best)


def test_gradient_matches_differences():
    crf = html_text.ChainCRF()
    feats, y = [[1, 5], [2, 5], [1, 7]], [0, 1, 1]
    rng = np.random.default_rng(0)
    crf.w[:10], crf.trans, crf.start = rng.normal(size=(10, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)

    def loss():
        e, z = crf.emissions(feats), []
        for k in range(8):
            s = [k >> i & 1 for i in range(3)]
            z.append(crf.start[s[0]] + sum(e[i, c] for i, c in enumerate(s)) + sum(crf.trans[a, b] for a, b in zip(s, s[1:])))
        own = crf.start[y[0]] + sum(e[i, c] for i, c in enumerate(y)) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))
        return np.logaddexp.reduce(z) - own

    node, edge, first = crf.gradient(feats, y)
    for a in range(2):
        for b in range(2):
            before = loss()
            crf.trans[a, b] += 1e-6
            assert (loss() - before) / 1e-6 == pytest.approx(edge[a, b], abs=1e-4)
            crf.trans[a, b] -= 1e-6


def test_extraction_operator(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>m</a></nav><article><h1>T</h1><p>One two.</p></article><footer>&copy; x</footer>"), (3, "u", "<article><p>One&nbsp;\n two</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.digest(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "One two", 7), (3, "T\n\nOne two.", 11)]
    assert html_text.digest(pages.filter("false")).count() == 0


def edited(text, rate, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(int(rate * len(w))):
        k = r.randrange(len(w))
        op = r.randrange(3)
        if op == 0:
            w[k] = f"zz{r.randrange(99)}"
        elif op == 1:
            del w[k]
        else:
            w.insert(k, f"yy{r.randrange(99)}")
    return " ".join(w)


def test_decontamination(spark, frame):
    bench = [(i, prose(25 + i, 500 + i)) for i in range(20)] + [(50, None), (51, "too short")]
    rows = [(i, prose(60, i) + " " + bench[i % 20][1].upper() + "!! " + prose(40, 80 + i)) for i in range(20)]
    rows += [(100 + i, prose(30, i) + " " + edited(bench[i % 20][1], 0.1, i) + " " + prose(20, 3)) for i in range(40)]
    rows += [(200 + i, prose(150, 900 + i)) for i in range(30)]
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    hits = decontamination.contaminated(frame(rows), benchmark).collect()
    pairs = {(r.doc_id, r.item_id): r.edits for r in hits}
    assert all(pairs.get((i, i)) == 0 for i in range(20))
    assert sum((100 + i, i % 20) in pairs for i in range(40)) >= 37
    assert not any(d >= 200 for d, _ in pairs)
    kept = {r.doc_id for r in decontamination.clean(frame(rows), benchmark).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in pairs}
    assert decontamination.contaminated(frame(ODD), benchmark).count() == 0
    assert decontamination.contaminated(frame([]), benchmark).count() == 0
    assert decontamination.contaminated(frame(rows), benchmark.filter("false")).count() == 0


@pytest.mark.parametrize("where", ["head", "middle", "tail"])
def test_decontamination_of_edits_in_one_place(spark, frame, where):
    bench = [(i, prose(n, 700 + i)) for i, n in enumerate([15, 25, 40, 59, 59, 120] * 3)] + [(90, prose(5, 790))]
    rows = []
    for i, text in bench:
        w = text.split()
        e = len(w) // 5
        a = {"head": 0, "middle": len(w) // 2 - e // 2, "tail": len(w) - e}[where]
        rows.append((i, prose(30, i) + " " + " ".join(w[:a] + w[a + e :]) + " " + prose(30, 50 + i)))
        rows.append((100 + i, " ".join(w[:a] + [f"new{k}" for k in range(e)] + w[a + e :])))
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    hits = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(rows), benchmark).collect()}
    assert hits == {(d, d % 100) for d, _ in rows}


@pytest.mark.parametrize("n", [5, 10, 20, 40, 100, 400])
@pytest.mark.parametrize("short", [False, True])
def test_recall_of_the_sampled_walks(n, short):
    """Copies at 20 % edits, by dynamic programming within the limit: candidates must hold 0.9 of them wherever the edits stand."""
    for where in ("random", "spaced", "head", "middle", "tail"):
        texts = [prose(n, 1000 + k) for k in range(40)]
        items = decontamination.Items(list(range(40 + short)), texts + [prose(5, 99)] * short, 0.8)
        copies = []
        for k, t in enumerate(texts):
            r, w = random.Random(k), t.split()
            e = n // 5
            at = {"random": r.sample(range(n), e), "spaced": [int((j + 0.5) * n / e) for j in range(e)], "head": range(e), "middle": range(n // 2 - e // 2, n // 2 - e // 2 + e), "tail": range(n - e, n)}[where]
            for j in sorted(at, reverse=True):
                w[j : j + 1] = [[f"new{j}"], [], [w[j], f"new{j}"]][r.randrange(3) if where in ("random", "spaced") else 0]
            copies.append(prose(15, k + 1) + " " + " ".join(w) + " " + prose(15, k + 2))
        hits = {(row, item) for row, item, *_ in decontamination.matches(items, pa.array(copies))}
        assert sum((k, k) in hits for k in range(40)) >= 38, where


def test_decontamination_in_scripts_without_spaces_and_of_short_items(spark, frame):
    r = random.Random(8)
    han = "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(60))
    thai = "".join(chr(r.randrange(0x0E01, 0x0E2E)) for _ in range(40)) + " 2024 " + chr(0x0E01) * 3
    bench = [(1, han), (2, thai), (3, "It’s the “last” word – of\u00a0all, today"), (4, "forty two"), (5, "?!"), (6, "naïve")]
    rows = [
        (1, "前" + han[:20] + "乙丙" + han[22:] + "。後"),
        (2, "x" + thai + "y"),
        (3, "he said it's the \"last\" word - of all, today."),
        (4, "it is Forty-Two now"),
        (5, "forty and two ?!"),
        (6, "forty twos, naïvely"),
        (7, "so naïve!"),
    ]
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    hits = {(h.doc_id, h.item_id, h.edits) for h in decontamination.contaminated(frame(rows), benchmark).collect()}
    assert hits == {(1, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0), (7, 6, 0)}


def test_words_of_many_scripts():
    texts = ["ab é日本x", "", "語", "a\u3000b\u2019c", "😀😀a", "\U00020000z", "日", "ß"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, row = X.unicode_words(data, np.cumsum([0] + [len(x) for x in raw]))
    got = [(int(k), bytes(data[a:b]).decode()) for a, b, k in zip(start, end, row)]
    want = [["ab", "é", "日", "本", "x"], [], ["語"], ["a", "b", "c"], ["😀", "😀", "a"], ["\U00020000", "z"], ["日"], ["ß"]]
    assert got == [(k, w) for k, ws in enumerate(want) for w in ws]


def test_smallest_distance_against_dynamic_programming():
    r = random.Random(5)

    def brute(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        return best

    for _ in range(50):
        p = np.array([r.randrange(1, 5) for _ in range(r.randrange(1, 9))])
        t = np.array([[r.randrange(5) for _ in range(12)] for _ in range(3)])
        edits, _ = decontamination.smallest_distance(p, t)
        assert edits.tolist() == [brute(p.tolist(), x) for x in t.tolist()]


@pytest.mark.parametrize("tag", ["object", "video", "audio", "canvas", "svg", "math", "select"])
def test_unclosed_embedded_elements_hide_nothing(tag):
    texts = [b.text for b in html_text.blocks_of(f"<p>one</p><{tag}><p>two</p><script>var x;</script><p>three</p>")]
    assert texts == ["one", "two", "three"]
    assert [b.text for b in html_text.blocks_of(f"<p>one</p><{tag}>gone</{tag}><p>two</p>")] == ["one", "two"]


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="wrap"><div class="col-8"><p>One long sentence stands here, as it does.</p><p>Two is another one.</p></div></div>', "One long sentence stands here, as it does.\n\nTwo is another one."),
        ("<p>The first paragraph says a thing.</p><p>The second one says more.</p>", "The first paragraph says a thing.\n\nThe second one says more."),
        ("<body><p>one paragraph</p></body>", "one paragraph"),
        ("Just plain text without any tag at all.", "Just plain text without any tag at all."),
        ('<div id="bodyContent"><p>First par of the text.</p><p>Second par of it, a bit longer.</p></div>', "First par of the text.\n\nSecond par of it, a bit longer."),
        ('<article><p>Shown text is here.</p><div style="display:none"><p>Hidden text is not.</p></div><p>More shown text.</p></article>', "Shown text is here.\n\nMore shown text."),
        ("<div><p>We use cookies to improve your visit.</p><button>Accept</button></div><article><h1>T</h1><p>Real text is here.</p></article>", "T\n\nReal text is here."),
        ('<p>one is here.</p><svg><path d="x"><p>two is here.</p><p>three is here.', "one is here.\n\ntwo is here.\n\nthree is here."),
        ("<table><tr><td><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></td><td><h1>Title</h1><p>Text of the page is here.</p></td></tr></table>", "Title\n\nText of the page is here."),
        ("<div>First block of text, which is long enough.</div><div>Second block of text, also long.</div>", "First block of text, which is long enough.\n\nSecond block of text, also long."),
    ],
)
def test_extraction_of_hand_labelled_pages(page, text):
    assert html_text.main_text(page, html_text.default_model()) == text


def test_unclosed_tags_take_linear_time():
    import time

    for page in ("<p>x</p>" + "<span>a <div>b" * 60_000, "<span class=x>a " * 60_000):
        start = time.perf_counter()
        assert sum(len(b.text) for b in html_text.blocks_of(page)) > 60_000
        assert time.perf_counter() - start < 20  # some four seconds on an idle machine


def brute_kneser_ney(pairs):
    """log P_1/P_0 by plain dictionaries: pairs[c] counts documents of class c by (v, w)."""

    def cuts(values):
        n = [max(1, sum(x == k for x in values)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), 0.95 * k) for k in (1, 2, 3)]

    words = {""} | {w for c in pairs for _, w in c}
    both = pairs[0] + pairs[1]

    def lower(count, base):
        seen = Counter(w for (_, w), n in count.items() if n)
        d, total = cuts(list(seen.values()) + [0] * (len(words) - len(seen))), sum(seen.values())
        free = sum(d[min(n, 3)] for n in seen.values()) / total
        return {w: (seen[w] - d[min(seen[w], 3)]) / total + free * base[w] for w in words}

    types = Counter(w for _, w in both)
    even = {w: (types[w] + toxicity.ADDITIVE) / (sum(types.values()) + toxicity.ADDITIVE * len(words)) for w in words}

    def higher(count, back):
        d, total, free = cuts([count[p] for p in both]), Counter(), Counter()
        for (v, _), n in count.items():
            total[v] += n
            free[v] += d[min(n, 3)]

        def p(v, w):
            if not total[v]:
                return back(v, w)
            return (count[v, w] - d[min(count[v, w], 3)]) / total[v] + free[v] / total[v] * back(v, w)

        return p

    shared = higher(both, lambda v, w: even[w])
    base = [lower(pairs[c], even) for c in (0, 1)]
    p = [higher(pairs[c], lambda v, w, c=c: base[c][w] / 2 + shared(v, w) / 2) for c in (0, 1)]
    return lambda v, w: (math.log(base[1][w] / base[0][w]), math.log(p[1](v, w) / p[0](v, w)))


def test_kneser_ney_against_dictionaries():
    texts = [[prose(60, 10 * c + k).lower() for k in range(8)] for c in (0, 1)]
    pairs, hashes = [Counter(), Counter()], {}
    for c in (0, 1):
        for t in texts[c]:
            w = re.findall("[a-z0-9]+", t)
            h, before, _ = toxicity.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            assert len(h) == len(w)
            for a, b, x, y in zip([""] + w, w, before, h):
                hashes[a], hashes[b] = x, y
            pairs[c].update(set(zip([""] + w, w)))
    every = sorted(pairs[0] | pairs[1])
    v, w = (np.array([hashes[p[k]] for p in every], np.uint64) for k in (0, 1))
    model = toxicity._opened(toxicity.fit_pair(v, w, np.array([[c[p] for p in every] for c in pairs], float)))
    want = brute_kneser_ney(pairs)
    new = [(a, b) for a, _ in every[:20] for _, b in every[-20:]]
    for p in every[::7] + new:
        one, two = toxicity.ratios(model, np.array([hashes[p[1]]]), np.array([hashes[p[0]]]))
        assert (one[0], two[0]) == pytest.approx(want(*p), abs=2e-4), p
