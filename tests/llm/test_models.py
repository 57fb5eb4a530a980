import gc
import math
import random
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import lower_ascii, spaced_words
from pyspark.sql import functions as F

from sparkloom.llm import ann, html_extract, language_id, lm_score, packing, quality, vec

EXTRA = "source string, n_chars long, score double, held_out string, predicted string, rest string, row int, pieces string"


def frame(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 9.0, "x", "y", "z", 3, "p") for i, t, lang in rows], "doc_id long, text string, lang string, " + EXTRA)


ODD = [(None, None, None), (None, "words of a row", "en"), (1, None, "en"), (1, "", None), (2, " \n ", "en"), (3, "123 !!!", "en"), (4, "ok", "en"), (4, "ok", "en")]
ENGLISH = "the people of this country have the right to read and write what they think about the weather and the news "
GERMAN = "die menschen in diesem land haben das recht zu lesen und zu schreiben was sie über das wetter und die nachrichten denken "


def corpus():
    rng = random.Random(1)
    out = []
    for i in range(120):
        base, lang = ((ENGLISH, "en"), (GERMAN, "de"))[i % 2]
        words = base.split()
        rng.shuffle(words)
        out.append((1000 + i, " ".join(words[: rng.randint(6, len(words))]), lang))
    return out


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# language ID


def test_memory_of_profiles_does_not_grow_with_a_batch():
    words = (ENGLISH + GERMAN).split()
    rng = random.Random(2)
    texts = pa.array([" ".join(rng.choice(words) for _ in range(1000)) for _ in range(600)])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * len(texts))], ["text", "lang"])
    language_id._letters()
    tracemalloc.start()
    n = sum(sum(out.column(2).to_pylist()) for out in language_id._training_rows([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 6_000_000 and peak < 100_000_000


def test_languages_of_held_out_texts(spark):
    rows = corpus() + ODD
    got = language_id.predict_held_out(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang in corpus()}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got if r["doc_id"] is not None)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)) == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_out_of_place_distance_by_hand():
    """Profiles and a text counted with plain Python give the same distances."""

    def grams(text):
        out, word = {}, "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in word:
            padded = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g.strip() and " " not in g[1:-1]:
                        out[g] = out.get(g, 0) + 1
        return out

    text = "ab ab abc d Ab"
    data, offsets = vec.text_bytes(pa.array([text]))
    rows, codes = language_id._ngrams(*language_id._symbols(data, offsets))
    counts = np.unique(codes, return_counts=True)[1]
    # spaces between words are shared marks, so that boundaries of one letter are counted alike
    assert sorted(counts) == sorted(grams(text).values())


def test_identified_rows_keep_their_columns(spark):
    df = frame(spark, corpus() + ODD)
    out = language_id.keep_identified(df)
    assert out.columns == df.columns and out.count() == len(corpus()) + 3
    assert language_id.keep_identified(frame(spark, [])).count() == 0
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_identified(unknown).collect()} == {r["doc_id"] for r in out.collect()}
    assert [r["lang_pred"] for r in language_id.predict_held_out(frame(spark, [(1, "text", None)])).collect()] == ["und"]


# quality


def test_junk_scores_low_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        words = [rng.choice(ENGLISH.split()) for _ in range(rng.randint(20, 60))]
        text = " ".join(words) + "." if good else "".join(w + rng.choice(["### ", "$$$ ", " | "]) for w in words)
        rows.append((i, text, "en"))
        if i % 2 == 0:
            labels.append((i, int(good)))
    got = quality.score_held_out(frame(spark, rows + ODD), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held if r["doc_id"] > 4]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_class_prior_from_positives_and_unlabelled_scores():
    rng = np.random.default_rng(3)
    for share in (0.1, 0.5, 0.9):
        positive = rng.beta(8, 2, 4000)
        unlabelled = np.concatenate((rng.beta(8, 2, int(8000 * share)), rng.beta(2, 8, 8000 - int(8000 * share))))
        assert abs(quality.class_prior(positive, unlabelled) - share) < 0.06
    assert 0 < quality.class_prior(np.zeros(0), np.zeros(0)) < 1


def test_quality_sample_holds_each_id_once(spark):
    rows = [(7, f"copy {i % 3}", "en") for i in range(500)] + [(i, f"text of {i}", "en") for i in range(100, 130)]
    got = quality.sample(frame(spark, rows), spark.createDataFrame([(7, 1), (7, 0), (101, 1)], "doc_id long, quality int"), 10, 20)
    assert len(got[0]) == 2 and len(got[1]) == 20


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_held_out(frame(spark, []), none).count() == 0
    assert quality.score_held_out(frame(spark, ODD), none).count() == len(ODD)


def test_risk_estimate_stays_non_negative_in_effect():
    rng = np.random.default_rng(0)
    x = np.zeros((400, quality.WIDTH), dtype=np.float32)
    x[:, :8] = rng.standard_normal((400, 8)) * 0.1
    x[:200, 0] += 2
    model = quality.fit(x[:100], x, 0.5, epochs=200)
    score = model.score(x)
    assert (score[:200] > 0.5).mean() > 0.95 and (score[200:] < 0.5).mean() > 0.9


# language model


def test_base_score_and_counts_are_exact(spark):
    rows = corpus() + ODD
    got = lm_score.score_held_out(frame(spark, rows)).collect()
    counts = {}
    for i, t, _ in rows:
        if i is not None and fold(i, 5) != 1:
            for w in [*spaced_words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    plain = sorted(
        (str(i), len(spaced_words(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*spaced_words(t), None]), round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*spaced_words(t), None]), 6))
        for i, t, _ in rows
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == plain
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.score_held_out(frame(spark, [])).count() == 0
    assert lower_ascii("ÀB") == "Àb"


def test_filter_returns_levels_of_all_it_holds():
    rng = np.random.default_rng(5)
    grams = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    counts = rng.geometric(0.2, 3000)
    shard = grams % np.uint64(16)
    parts = {}
    for s in range(16):
        at = shard == s
        t = pa.table({"grams": pa.array([grams[at].tobytes()]), "n": pa.array([counts[at].astype(np.uint32).tobytes()])})
        parts[16 + s] = lm_score._build(16)((pa.scalar(16 + s, pa.int32()),), t).column("bits")[0].as_py()
    f = lm_score.Filter(parts, 16)
    found, level = f.levels(grams, 1), lm_score.level(counts)
    assert (found >= level).all() and (found == level).mean() > 0.92
    assert (f.levels(rng.integers(1, 2**63, 3000, dtype=np.uint64), 1) > 0).mean() < 0.06
    assert not f.levels(grams, 0).any()


def test_scores_are_those_of_a_plain_model_and_the_same_from_shards(spark):
    rows = [(i, t) for i, t, _ in corpus()] + [(i, t) for i, t, _ in ODD] + [(90, "word " * 70_000), (91, "The Weather and THE NEWS"), (92, "neu " * 3)]
    df = frame(spark, [(i, t, None) for i, t in rows])
    held = sorted(map(tuple, lm_score.score_held_out(df).collect()), key=str)
    sharded = sorted(map(tuple, lm_score.score_held_out(df, max_mb=0).collect()), key=str)
    assert held == sharded
    counts = {}
    split = [["<s>", *spaced_words(t), "</s>"] for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        if i is not None and fold(i, 5) != 1:
            for n in (1, 2):
                for j in range(0 if n > 1 else 1, len(w) - n + 1):
                    counts[tuple(w[j : j + n])] = counts.get(tuple(w[j : j + n]), 0) + 1
    total = sum(v for k, v in counts.items() if len(k) == 1)
    distinct = sum(len(k) == 1 for k in counts)

    def value(gram):
        gram = ("</s>",) if gram == ("<s>",) else gram
        return float(lm_score._VALUES[lm_score.level(np.array([counts[gram]]))[0]]) if gram in counts else 0.0

    def score(w):
        out = 0.0
        for j in range(1, len(w)):
            p = (value((w[j],)) + 0.5) / (total + 0.5 * (distinct + 1))
            context = value((w[j - 1],))
            a = min(0.7, 0.3 + 0.1 * math.log10(context)) if context else 0.0
            p = a * min(1.0, value(tuple(w[j - 1 : j + 1])) / max(context, 1)) + (1 - a) * p
            out += math.log10(p)
        return out

    got = {r[0]: r[-1] for r in held if r[0] is not None}
    want = {i: score(w) for (i, _), w in zip(rows, split, strict=True) if i is not None}
    assert got.keys() == want.keys()
    # false positives, some of a hundred n-grams, change the rest
    off = sorted((got[i] - want[i]) / abs(want[i]) for i in want)
    assert -0.2 < off[len(off) // 10] <= off[len(off) // 2] <= off[-len(off) // 10] < 0.2, off
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.02)


# nearest neighbours


def test_neighbours_reach_recall_and_exact_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[100:160] = x[7]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [0.0] * 24), (1001, [float("nan")] * 24), (1002, [1.0] * 3), (None, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hit += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
    assert hit >= 0.97 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[100])][:3] == [7, 101, 102]


def test_neighbours_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [5.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id = 0"), 10).collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0), df.limit(0), 10).count() == 0


# packing


def packed(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(frame(spark, rows)).collect()
    want = {}
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = want[r["doc_id"], r["doc_tokens"]][0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"] > 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    total = {}
    for r in got:
        total[r["doc_id"], r["doc_tokens"]] = total.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
    assert total == {k: k[1] * len(v) for k, v in want.items()}
    return got


def test_packing_round_trip(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(ENGLISH.split()) for _ in range(rng.choice([3, 200, 900, 2500]))), "en") for i in range(150)]
    rows += ODD + [(700, "long " * 20_000, "en"), (701, "İstanbul Ǆ é 漢字 <|endoftext|> it's WE'LL x\u0085y ²½", "en"), (702, "x" * 5000, "en")]
    packed(spark, rows)


def test_packing_of_little_and_nothing(spark):
    assert packed(spark, []) == []
    assert len({r["sequence_id"] for r in packed(spark, [(1, "", "en")])}) == 1
    packed(spark, [(1, "one two three", "en"), (2, None, "en")])


def test_column_generation_is_close_to_the_bound():
    units, demand = np.array([100, 90, 70, 33, 12]), np.array([50, 120, 200, 400, 900])
    patterns = packing.column_generation(units, demand, 256)
    used = sum(times for _, times in patterns)
    assert all((units * p).sum() <= 256 for p, _ in patterns)
    assert used <= math.ceil((units * demand).sum() / 256 * 1.03)
    got = np.zeros(5, dtype=int)
    for c, _, lo, hi, _ in packing.allot(units, demand, patterns):
        assert 0 <= lo < hi <= demand[c]
        got[c] += hi - lo
    assert (got <= demand).all() and got.sum() >= 0.95 * demand.sum()


# extraction


def test_extraction_of_pages_never_seen(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class='site-header'><h1>My site</h1><nav><ul><li><a href='/a'>Home</a></li>"
        "<li><a href='/b'>About</a></li></ul></nav></header><div class='cookie-notice'><p>We use cookies on this page.</p><button>OK</button></div><article><h1>Head&amp;line</h1>"
        "<p>First <b>bold</b>\n  words of the text, with more to follow.<p>Second &lt;part&gt; of it goes on here.</article><aside class='sidebar'><h3>More</h3><ul><li><a href='/x'>Link</a></li></ul></aside>"
        "<section id='comments'><h3>Replies</h3><div class='comment'><b>Ann</b><p>I do not agree with this at all.</p></div></section><form><label>Search</label><input></form>"
        "<script>var a='</p>';</script><footer>&copy; 2020 Site</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (2, "u", ""), (3, "u", "no markup at all"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<div><p>unclosed <a href=\"x>y"), (6, "u", "<article><p>" + "long words here. " * 20000 + "</p></article>")]
    got = html_extract.extract(spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "Head&line First bold words of the text, with more to follow. Second <part> of it goes on here."
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] == 2] == ["", ""]
    assert by[6]["n_chars"] == 17 * 20000 - 1 and len(got) == len(rows)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_messages_give_exact_marginals():
    rng = random.Random(2)
    model = html_extract.TreeModel([0.0] * (html_extract.HASHED + html_extract.SHAPES), [[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)], 0.0)
    parents, kinds = [-1, 0, 0, 1, 1, 3, 2], [0, 0, 1, 2, 2, 1, 0]
    odds = [rng.uniform(-2, 2) for _ in parents]
    total, marginal, pair = 0.0, [0.0] * 7, [0.0] * 7
    for bits in range(2**7):
        y = [bits >> i & 1 for i in range(7)]
        w = math.exp(sum(odds[i] * y[i] for i in range(7)) + sum(model.edges[kinds[i]][y[parents[i]]][y[i]] for i in range(1, 7)))
        total += w
        for i in range(7):
            marginal[i] += w * y[i]
            pair[i] += w * y[i] * y[parents[i]] if i else 0
    p, both = model.marginals(parents, odds, kinds)
    assert np.allclose(p, np.array(marginal) / total) and np.allclose(both[1:], np.array(pair[1:]) / total)


def test_held_out_labelled_pages():
    from sparkloom.llm.labelled_pages import labelled_pages

    model, wrong, words = html_extract.default_model(), 0, 0
    for page in labelled_pages(60, 77):
        nodes, _ = html_extract.parse(page)
        marks = ['data-y="1"' in x[2] for x in nodes]
        for x in nodes:
            x[2] = html_extract._MARK.sub("", x[2])
        tree = html_extract.Tree(nodes)
        content, _ = model.marginals(tree.parents, model.odds(tree), tree.kinds)
        wrong += sum(x[3] for x, at, y in zip(nodes, tree.places, marks, strict=True) if x[3] and (content[at] > 0.5) != y)
        words += sum(x[3] for x in nodes)
    assert wrong <= 0.05 * words


PROSE = "Some words of an article, enough of them to look like prose, stand here for the test. " * 4


@pytest.mark.parametrize("depth", [1, 5, 20, 400, 3000])
@pytest.mark.parametrize("attrs", ["", " class='css-1x2'"])
def test_depth_of_markup_does_not_weigh(depth, attrs):
    page = f"<html><body><nav><a href='/'>Home</a></nav><h1>A title of it</h1><p>{PROSE}</p>" + f"<div{attrs}>" * depth + f"<p>Deep. {PROSE}</p>" + "</div>" * depth + "<footer>&copy; us</footer></body></html>"
    assert html_extract.default_model().extract(page) == f"A title of it {PROSE.strip()} Deep. {PROSE.strip()}"


@pytest.mark.parametrize("tag", sorted(html_extract._SKIPPED) + ["title", "textarea", "iframe", "noframes", "xmp"])
def test_elements_left_open_keep_the_rest_of_the_page(tag):
    model = html_extract.default_model()
    page = f"<body><article><h1>A title</h1><p>{PROSE}</p><{tag} a='b'><p>After. {PROSE}</p></article><footer>&copy; us</footer></body>"
    assert model.extract(page) == f"A title {PROSE.strip()} After. {PROSE.strip()}"


@pytest.mark.parametrize("tag", sorted(html_extract._SKIPPED))
def test_skipped_elements_end_where_they_are_closed(tag):
    model = html_extract.default_model()
    nested = f"<{tag}>one<{tag}>two</{tag}>three</{tag}>"
    crossed = f"<div><{tag}></div><p>After. {PROSE}</p></{tag}>"
    assert model.extract(f"<article><h1>A title</h1><p>{PROSE}</p>{nested}{crossed}</article>") == f"A title {PROSE.strip()} After. {PROSE.strip()}"


def test_references_are_decoded_before_texts_are_joined():
    model = html_extract.default_model()
    page = f"<article><h1>A title</h1><p>{PROSE}AT&<b>amp;</b> x &<!-- c -->lt; y &lt;z&gt; &copy</p></article>"
    assert model.extract(page) == f"A title {PROSE}AT&amp; x &lt; y <z> ©"


@pytest.mark.parametrize("notice", ['<div role="alert"><p>We use cookies here.</p></div>', '<div class="notice">Please subscribe to our letter.</div>', '<aside class="newsletter"><p>Get our letter.</p><button>Go</button></aside>', '<div class="alert"><p>This page is out of date.</p></div>'])
def test_notices_inside_an_article_go(notice):
    model = html_extract.default_model()
    page = f"<body><header class='top'><p>Site</p></header><article><h1>A title</h1><p>{PROSE}</p>{notice}<p>After. {PROSE}</p></article><footer>&copy; us</footer></body>"
    assert model.extract(page) == f"A title {PROSE.strip()} After. {PROSE.strip()}"


def test_a_task_leaves_no_encoder_behind(monkeypatch):
    made = []

    class Noted(packing.Encoder):
        def __init__(self, path):
            super().__init__(path)
            made.append(weakref.ref(self))

    monkeypatch.setattr(packing, "Encoder", Noted)
    run = packing._token_rows(packing.tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], ["doc_id", "text"])
    assert [out.num_rows for out in run([batch])] == [1]
    gc.collect()
    assert made and not any(x() for x in made)
