"""The ten operators and the pipeline against brute force, on small tables with every awkward row."""

from __future__ import annotations

import hashlib
import html
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tracklight.llm import chat, decontaminate, entry_queries, fingerprint, htmltext, language, linedup, mixing, neardup, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(H.documents(), H.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], H.SCHEMA)


def clashing(docs):
    """Extra columns with names that operators use inside."""
    return docs.select("*", *[F.lit("clash").alias(c) for c in ("size", "h", "tie", "range", "row", "key", "src", "rated", "spoken", "placed", "mixed", "contamination", "deduped", "result", "score", "n", "label", "shard", "slot", "again")])


# ------------------------------------------------------------------------------------------------ 1
def test_decontamination_equals_brute_force(spark, docs):
    texts = dict((r[0], r[1]) for r in H.documents())
    w = H.words(texts[3])
    benchmark = [(1, " ".join(w[100:140]).upper()), (2, " ".join(w[110:125])), (2, "one two THREE"), (3, None), (4, "..."), (10, "unseen words " * 9), (None, "Ä")]
    found = H.windows([("null" if i is None else i, t) for i, t in benchmark])
    table = spark.createDataFrame(benchmark, "item_id bigint, text string")
    for block in (1 << 24, 80):  # one block, and several passes
        got = decontaminate.decontaminate(clashing(docs), table, name="contamination", block_bytes=block)
        name = got.columns[-1]
        for r in got.collect():
            n, hit, items = H.contamination(texts[r.doc_id], found)
            assert (r[name].n_words, r[name].n_hit, r[name].items) == (n, hit, items)
            spans = [(s.first, s.last) for s in r[name].spans]
            assert sum(b - a + 1 for a, b in spans) == hit
            assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:], strict=False))  # merged and in order


def test_decontamination_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(empty, none).count() == 0
    assert {r.contamination.n_hit for r in decontaminate.decontaminate(docs, none).collect()} == {0}
    twice = docs.unionByName(docs)
    assert decontaminate.decontaminate(twice, none).count() == 2 * docs.count()


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 3000), 0)
    index = decontaminate.FMIndex(text, 4)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 2, 1, 3, 3]):
        lo, hi = index.search(np.array([pattern]))
        want = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


# ------------------------------------------------------------------------------------------------ 2
def check_mix(rows, by_source):
    taken, total = {}, sum(by_source.values())
    names = sorted(by_source, key=lambda s: (s is None, s))
    weight, cap = {s: 1 + i % 3 for i, s in enumerate(names)}, {s: 3 * by_source[s] for s in names}
    target, free, left = {}, set(names), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap[s]
            free.discard(s)
            left -= cap[s]
    for r in rows:
        assert r.source_size == by_source[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return taken, target


def test_mixing_meets_targets(spark):
    rows = entry_queries.QUERIES["op2_mixing"](spark, SF).collect()
    by_source, seen = {}, spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in seen:
        by_source[r.source] = by_source.get(r.source, 0) + len(H.NONSPACE.findall(r.text or ""))
    taken, target = check_mix(rows, by_source)
    for s in target:  # sources of ten documents
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 1
    again = entry_queries.QUERIES["op2_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(clashing(docs))
    name = out.columns[-1]
    assert out.count() == docs.count() and all(0 <= r[name].copies <= 3 for r in out.collect())
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.mixed.copies for r in mixing.mix(docs).collect())
    blank = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, "b", 1)], H.SCHEMA)
    assert {(r.mixed["size"], r.mixed.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}
    repeated = docs.unionByName(docs)
    assert mixing.mix(repeated).count() == 2 * docs.count()


def test_mixing_of_null_and_repeated_ids_meets_targets(spark):
    rng = random.Random(8)
    rows = [(None if i < 40 else i, H.prose(rng, rng.randint(1, 9)) if i >= 20 else "one text of six words here", None, "ab"[i % 2], 1) for i in range(80)]
    rows += [(7, "same id and text", None, "c", 1)] * 30 + [(100 + i, H.prose(rng, 5), None, "d", 1) for i in range(30)]
    df = spark.createDataFrame(rows, H.SCHEMA).coalesce(2)
    out = mixing.mix(df).collect()
    by_source, taken = {}, {}
    for r in out:
        by_source[r.source] = by_source.get(r.source, 0) + r.mixed["size"]
        taken[r.source] = taken.get(r.source, 0) + r.mixed.copies * r.mixed["size"]
    target = {r.source: r.mixed.target for r in out}
    assert all(abs(taken[s] - target[s]) <= 3 for s in target) and len(out) == len(rows)


# ------------------------------------------------------------------------------------------------ 3
def dedup(rows):
    first, lines = {}, {}
    for i, text in rows:
        ls = text.split("\n") if text else []
        lines[i] = ls
        for p in range(max(1, len(ls) - 2) if ls else 0):
            w = tuple(ls[p : p + 3])
            if any(x.strip(" ") for x in w):
                first.setdefault(w, (i, p))
    out = {}
    for i, ls in lines.items():
        gone = set()
        for p in range(max(1, len(ls) - 2) if ls else 0):
            w = tuple(ls[p : p + 3])
            if w in first and first[w] != (i, p):
                gone |= set(range(p, p + len(w)))
        out[i] = [x for k, x in enumerate(ls) if k not in gone]
    return out


def test_line_dedup_equals_brute_force(spark, empty):
    rng = random.Random(5)
    pool = ["a", "b", "c d", "", " ", "é"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "same\nsame\nsame\nsame\nsame")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = dedup(rows)
    for r in linedup.dedup_lines(clashing(df)).collect():
        d = r[-1]
        expected = "\n".join(want[r.doc_id]) if r.text else r.text
        assert d.text == expected and d.n_lines == (len(r.text.split("\n")) if r.text else 0)
    assert linedup.dedup_lines(empty).count() == 0
    twice = linedup.dedup_lines(df.unionByName(df))
    assert twice.count() == 2 * len(rows)


def test_line_dedup_of_long_texts_and_null_ids(spark):
    """A text of 30,000 lines, all of them removed but the first ones, takes no longer than its lines."""
    import time

    long_ = "\n".join(f"line {i % 7}" for i in range(30_000))
    rows = [(1, long_), (None, long_), (None, "a\nb\nc\nd"), (0, "a\nb\nc"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.time()
    got = sorted(((r.doc_id is None, r.deduped.n_lines, r.deduped.text) for r in linedup.dedup_lines(df).collect()), key=str)
    assert time.time() - began < 60
    first = "\n".join(f"line {i}" for i in range(7))
    assert got == sorted([(False, 30_000, first), (True, 30_000, ""), (True, 4, "d"), (False, 3, "a\nb\nc"), (True, 0, None)], key=str)


# ------------------------------------------------------------------------------------------------ 4
def test_trees_learn_and_score_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.Trees(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for flat in (quality.Trees(x[:0], y[:0]), quality.Trees(x[:9], np.ones(9))):
        assert len(set(flat.score(x[:50]))) == 1


def test_quality_on_held_out_rows(spark):
    rows = entry_queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rated, name = quality.score_quality(clashing(docs), none)
    assert {r[name].score for r in rated.collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 1), (3, None), (5, 0), (9, 0)], "doc_id bigint, quality int")
    rated, name = quality.score_quality(docs, labels)
    scores = {r.doc_id: r[name].score for r in rated.collect()}
    assert len(scores) == docs.count() and scores[0] == scores[1] and scores[4] == scores[5]
    assert quality.score_quality(empty, none)[0].count() == 0


def plain_statistics(text):
    """The statistics of one text, by loops."""
    raw = (text or "").encode()
    kind = {}
    for name, of in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t"), ("newline", b"\n\r"), ("stop", b"."), ("comma", b",;:"), ("bang", b"!?"), ("bar", b"|"),
        ("symbol", b"#$%&*+/<=>@\\^_`{}~[]"), ("quote", b"\"'()-"), ("lead", range(192, 256)), ("tail", range(128, 192)),
    ):
        kind |= dict.fromkeys(of, name)
    counts = dict.fromkeys(quality.CLASSES, 0)
    for b in raw:
        counts[kind.get(b, "other")] += 1
    chars = len(raw) - counts["tail"]
    ratio = lambda a, b: a / max(b, 1)
    words = [w.encode() for w in H.NONSPACE.findall(text or "")]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    sizes, n = [len(w) for w in words], len(words)
    mean = ratio(sum(sizes), n)
    spread = max(0.0, ratio(sum(x * x for x in sizes), n) - mean**2) ** 0.5
    often = lambda xs: max((xs.count(x) for x in set(xs)), default=0)
    pairs = list(zip(low, low[1:], strict=False))
    alpha = lambda w: sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w)
    ups = lambda w: sum(65 <= c <= 90 for c in w)
    lines = [x.encode() for x in (text or "").split("\n") if x]
    return [
        *[counts[c] / max(chars, 1) for c in quality.CLASSES], np.log1p(chars), np.log1p(n), mean, spread, max(sizes, default=0), ratio(len(set(low)), n), ratio(often(low), n), ratio(sum(a == b for a, b in pairs), n), ratio(len(set(pairs)), n - 1),
        ratio(often(pairs), n - 1), ratio(sum(ups(w) >= 2 and 2 * ups(w) > alpha(w) for w in words), n), ratio(sum(alpha(w) == 0 for w in words), n), ratio(sum(len(w) - alpha(w) >= 2 for w in words), n), ratio(sum(len(w) == 1 for w in words), n),
        len(lines), ratio(len(set(lines)), len(lines)), ratio(often(lines), len(lines)), ratio(sum(x.endswith(b".") for x in lines), len(lines)), ratio(sum(map(len, lines)), len(lines)), ratio(n, len(lines)),
        len(set(low)) / max(n, 1) ** 0.5, ratio(counts["stop"], n), ratio(counts["upper"], n),
    ]


def test_statistics_and_scores_equal_brute_force(spark):
    texts = [r[1] for r in H.documents()] + ["THE THE the. 12 !!\n\na|b <x> ÄÖ\n. ., aa aa aa aa\r\nx", "\n \n", "A" * 500, "é|" * 40]
    got = quality.statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, np.array(plain_statistics(text), np.float32), rtol=1e-5, atol=1e-6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    trees = quality.Trees(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for feature, split, leaf in zip(trees.feature, trees.split, trees.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                bin_ = sum(bool(e < row[feature[node]]) for e in trees.edges[feature[node]])
                node = 2 * node + (2 if bin_ > split[node] else 1)
            total += leaf[node - (2**quality.DEPTH - 1)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


# ------------------------------------------------------------------------------------------------ 5
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class="ad">buy this now, it is a very long advert with many words in it</div>
<article><h1>Head &amp; more</h1><p>First <b>para</b> of
 text.<p>Second&nbsp;one</article><div id="comments"><p>I like this very much, a long comment of a reader.</p></div><footer>foot</footer><script>var a="</p>";</script>"""


def test_html_text(spark):
    assert htmltext.main_text(PAGE) == "Head & more\nFirst para of text.\nSecond one"
    assert [htmltext.main_text(x) for x in (None, "", "<nav>x</nav>", "plain < text", "<p>a<p>b")] == ["", "", "", "plain < text", "a\nb"]
    assert htmltext.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id bigint, url string, html string, article string")
    out, name = htmltext.extract(pages)
    assert sorted((r.page_id, r[name].text) for r in out.collect())[0][1] == "Head & more\nFirst para of text.\nSecond one" and out.count() == 3
    assert htmltext.extract(pages.where("false"))[0].count() == 0


def test_html_text_goes_on_after_a_stray_angle_bracket():
    for stray, kept in (("<жук", "<жук"), ("<中文", "<中文"), ("<é", "<é"), ("</>", ""), ("</3>", ""), ("</ p>", ""), ("<3", "<3"), ("</ж>", "")):
        assert htmltext.main_text(f"<p>one {stray} two</p><p>three</p>") == " ".join(f"one {kept} two".split()) + "\nthree"
    assert htmltext.main_text("<p>one </3 two</p><p>three</p>") == "one\nthree"  # a comment up to the next ">"
    assert htmltext.main_text("<p>one</p>two </3 three <4") == "one\ntwo </3 three <4"
    assert [htmltext.main_text(f"<p>one</p>two {cut}") for cut in ("<div class", "</div")] == ["one\ntwo"] * 2
    assert htmltext.main_text("</" * 200_000) == "</" * 200_000


def test_html_text_of_pages_wrapped_in_a_form():
    prose, field = "<p>First para of text, long enough.</p><p>Second one, as long as that.</p>", "<label>Your name</label><input name=n><button>Go</button><select><option>a</select>"
    want = "First para of text, long enough.\nSecond one, as long as that."
    for wrap in ("form", "div role=form", "div role=dialog", "div role=search"):
        end = f"</{wrap.split()[0]}>"
        assert htmltext.main_text(f"<body><{wrap}><nav>menu</nav>{field}<div>{prose}</div>{end}</body>") == want  # most of the text
        assert htmltext.main_text(f"<body><{wrap}>{field}<article>{prose}</article>{end}<ul>{'<li><a href=x>other</a>' * 40}</ul></body>") == want  # an article
        assert htmltext.main_text(f"<body><div>{prose}</div><{wrap}>{field}<p>Write to us</p>{end}</body>") == want  # a form of the page
        assert htmltext.main_text(f"<body><article>{prose}<{wrap}>{field}<p>Write to us</p>{end}</article></body>") == want
        assert htmltext.main_text(f"<body><div>{prose}</div><{wrap}><aside><article>teaser</article></aside><p>Write to us</p>{end}</body>") == want


def test_html_text_density_decides():
    prose = [f"Sentence number {i} of the text says something, at some length." for i in range(40)]
    body = "".join(f"<p>{x}</p>" for x in prose)
    want = "\n".join(prose)
    menu = "<ul class=menu>" + "".join(f"<li><a href=/{i}>topic {i}</a>" for i in range(30)) + "</ul>"
    for hint in ("widget-content", "social", "notice", "page-with-sidebar", "share post"):  # words around most of the text
        assert htmltext.main_text(f"<body>{menu}<div class='{hint}'>{body}</div><div><p>short</p></div></body>").startswith(want)
    comments = "".join(f"<p>I think {x}</p>" for x in prose)
    assert htmltext.main_text(f"<body>{menu}<div>{body}</div><div id=comments>{comments}</div><div class='cookie-notice'><p>We use cookies</p></div></body>") == want
    assert htmltext.main_text(f"<body>{menu}<div>{body}</div><div class=sidebar><p>About us, a short text</p></div>") == want
    assert htmltext.main_text(f"<body>{menu}<div><h1>Head</h1>{body}<ul><li>one</li><li>two</li></ul><h3>More</h3></div><table class=nav><tr><td><a href=x>next</a></table>") == f"Head\n{want}\none\ntwo\nMore"
    assert htmltext.main_text("<p>Einstein wrote <math><mi>E</mi></math> today.") == "Einstein wrote E today."


def test_html_text_takes_time_by_length():
    import time

    for page in ("<div>" * 50_000 + "deep" + "</p>" * 50_000, "<p><b>" * 50_000 + "deep", "<li>" * 50_000 + "deep", "<b>" * 25_000 + "</i>" * 25_000 + "deep", '<a ">x' * 30_001 + "deep", "<td>" * 30_000 + "</li>" * 30_000 + "deep"):
        began = time.time()
        assert htmltext.main_text(page).endswith("deep")
        assert time.time() - began < 3  # about a second on an idle machine


def test_html_text_columns_and_long_pages(spark):
    long_ = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(20_000)) + "</article>"
    pages = spark.createDataFrame([(1, None, long_), (None, "u", "<p>a"), (None, "u", "<p>a")], "page_id bigint, url string, html string")
    clash = pages.select("*", *[F.lit("clash").alias(c) for c in ("article", "article_", "text", "n_chars")])
    out, name = htmltext.extract(clash)
    assert name == "article__" and out.columns == [*clash.columns, name]
    assert sorted(len(r[name].text.split("\n")) for r in out.collect()) == [1, 1, 20_000]


def test_html_text_of_given_pages(spark):
    import re

    for r in entry_queries.QUERIES["op5_html_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# ------------------------------------------------------------------------------------------------ 6
def test_near_duplicates_equal_brute_force(spark, docs):
    sets = {r[0]: H.shingles(r[1]) for r in H.documents()}
    found = {}
    for threshold in (85, 80):
        want = H.components(sets, threshold)
        got = {r.doc_id: r for r in neardup.near_duplicates(clashing(docs), threshold=threshold).collect()}
        assert len(got) == len(sets)
        for k in sets:
            assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), want[k], want[k] == k)
        found[threshold] = set(want.values())
    assert found[80] < found[85]
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == found[80]


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Many edits of one text: most are not close to the hub, and small blocks must still find every link."""
    rng = random.Random(9)
    base, rows = H.prose(rng, 60).split(" "), []
    for i in range(150):
        e = list(base)
        for _ in range(rng.randint(0, 4)):
            e[rng.randrange(len(e))] = H.prose(rng, 1)
        rows.append((i, " ".join(e)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    for threshold in (85, 80):
        want = H.components({i: H.shingles(t) for i, t in rows}, threshold)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, threshold=threshold).collect()} == want


def test_close_members_are_complete_and_few(spark):
    """Edits of few texts, short and long: both sides of all close pairs stay, with good and bad shingle counts; of a large
    group of texts that share four fifths of their words next to none stay."""
    rng = random.Random(12)
    texts = []
    for size in (7, 30, 90):
        base = H.prose(rng, size).split(" ")
        for _ in range(40):
            e = base[: rng.randint(max(5, size - 6), size)]
            for _ in range(rng.randint(0, 3)):
                e[rng.randrange(len(e))] = H.prose(rng, 1)
            texts.append(" ".join(e))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [H.shingles(t) for t in texts]
    # components by place: none holds two members of a pair that is looked for
    label = [i % 3 if i < 60 else i for i in range(len(texts))]
    members = spark.createDataFrame([(i, label[i], i % 2 == 1) for i in range(len(texts))], "rep bigint, label bigint, out boolean")
    close = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j] and (i % 2 or j % 2)]
    for counters in (1 << 18, 4):
        got = {r.rep for r in neardup.close_members(members, df, counters, 85).collect()}
        assert len(close) > 100 and {x for pair in close for x in pair} <= got
    base = H.prose(rng, 160)
    many = spark.createDataFrame([(i, base + " " + H.prose(rng, 40)) for i in range(3000)], "doc_id bigint, text string")
    assert neardup.close_members(spark.range(3000).select(F.col("id").alias("rep"), F.col("id").alias("label"), F.lit(True).alias("out")), many, threshold=85).count() < 150


def test_near_duplicates_edges(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b"), (3, "A B")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(rows).collect())
    assert got == [("3", "3", True), ("7", "3", False), ("7", "3", False), ("None", "None", True), ("None", "None", True)]


def test_one_of_repeated_rows_stays(spark):
    """Rows that repeat id and text: one stays, by hot keys too; an id's other text has its own verdict; rows without words
    or without an id stay."""
    copy, other = "one two three four five six", "nothing like the first one at all"
    rows = [(3, copy, "x")] * 200 + [(3, copy, "y"), (5, copy, "x"), (5, other, "x"), (8, other, "z"), (9, None, "x"), (9, None, "x"), (None, copy, "x"), (None, copy, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, text_a string").repartition(5)
    got = neardup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("3", copy), ("5", other), ("9", "None"), ("9", "None"), ("None", copy), ("None", copy)])


def test_powers_of_long_texts_are_not_kept(monkeypatch):
    from tracklight.llm import common

    monkeypatch.setattr(common, "KEPT_POWERS", 100)
    monkeypatch.setattr(common, "_POWERS", {})
    raw = np.frombuffer(b"some words, some words" * 20, np.uint8)
    long = common.span_hashes(raw, np.array([0, 12, 22]), np.array([10, 22, 32]))
    assert not common._POWERS and long[0] == long[1] == long[2]
    assert list(common.span_hashes(raw[:40], np.array([0]), np.array([10]))) == [long[0]] and common._POWERS


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.append(a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64))
    ra, rb = neardup.registers(a, np.array([4000]))[0], neardup.registers(b, np.array([4000]))[0]
    union = neardup.registers(np.unique(np.append(a, b)), np.array([5000]))[0]
    assert (np.maximum(ra, rb) == union).all()  # mergeable
    got = neardup.plausible(None, pa.array([ra.tobytes()]), pa.array([rb.tobytes()]), pa.array([4000]), pa.array([4000]))
    assert abs(got["estimate"][0] - 0.6) < 0.15


# ------------------------------------------------------------------------------------------------ 7
def rolled(b):
    out = []
    for i in range(len(b)):
        w = [b[i - j] if i >= j else 0 for j in range(7)]
        x = 0
        for j, c in enumerate(w):
            x ^= (c << (5 * j)) & 0xFFFFFFFF
        out.append((sum((8 - j) * c for j, c in enumerate(w)) + x + 1) & 0xFFFFFFFF)
    return out


def fingerprint_of(text):
    b = text.encode()
    r, k, parts = rolled(b), 0, []
    while sum(1 for h in r if h and h % (3 << k) == 0) >= 64:
        k += 1
    for kk in (k, k + 1):
        cuts = [i + 1 for i, h in enumerate(r) if h and h % (3 << kk) == 0]
        if b and (not cuts or cuts[-1] != len(b)):
            cuts.append(len(b))
        s, p = "", 0
        for c in cuts:
            raw = np.frombuffer(b[p:c], np.uint8)
            s += chr(fingerprint.ALPHABET[int(fingerprint.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(58))])
            p = c
        parts.append(s)
    return f"{3 << k}:{parts[0]}:{parts[1]}"


def likeness_of(x, y):
    """By the edit distance of the signatures at equal or neighbouring block sizes, if they share a run of four."""
    (bx, *sx), (by, *sy) = x.split(":"), y.split(":")

    def alike(a, b):
        if not a and not b:
            return 1.0
        run = min(4, len(a), len(b))
        if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
            return 0.0
        best = [0] * (len(b) + 1)
        for c in a:
            last, best = best, [0]
            for j, d in enumerate(b):
                best.append(last[j] + 1 if c == d else max(best[-1], last[j + 1]))
        return 2 * best[-1] / (len(a) + len(b))

    bx, by = int(bx), int(by)
    pairs = list(zip(sx, sy, strict=True)) if bx == by else [(sx[0], sy[1])] if bx == 2 * by else [(sx[1], sy[0])] if by == 2 * bx else []
    return round(max((alike(a, b) for a, b in pairs), default=0.0), 6)


def check_fingerprints(rows, ordered):
    """``rows``: (id, text, struct); ``ordered``: (id, text) in the order of succession, ties in any order."""
    after = {}
    for i, (k, text) in enumerate(ordered):
        after.setdefault((k, text), set()).add(ordered[(i + 1) % len(ordered)][1])
    for k, text, got in rows:
        edits = {t: text[: len(text) - len(text) // 2] + t[: len(text) // 2] for t in after[k, text]}
        nxt = [t for t, e in edits.items() if hashlib.sha256(e.encode()).hexdigest() == got.edited_sha256]
        assert got.n_chars == len(text) and nxt and got.fingerprint == fingerprint_of(text)
        assert any((got.edited_fingerprint, got.near_edited, got.near_next) == (fingerprint_of(edits[t]), likeness_of(fingerprint_of(text), fingerprint_of(edits[t])), likeness_of(fingerprint_of(text), fingerprint_of(t))) for t in nxt)


def test_fingerprints_equal_brute_force(spark, docs, empty, monkeypatch):
    ordered = sorted(((r[0], r[1] or "") for r in H.documents()), reverse=True)
    clash = clashing(docs).withColumn("printed", F.lit("clash"))
    out = fingerprint.fingerprint(clash)
    assert out.columns == [*clash.columns, "printed_"]
    rows = out.collect()
    assert len(rows) == len(ordered)
    check_fingerprints([(r.doc_id, r.text or "", r.printed_) for r in rows], ordered)
    assert fingerprint.fingerprint(empty).count() == 0
    assert fingerprint.fingerprint(docs.where("doc_id = 8")).count() == 1
    with pytest.raises(TypeError):
        fingerprint.fingerprint(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def test_fingerprints_of_null_and_repeated_ids(spark, monkeypatch):
    """Null ids and one id hold most rows; they are split into ranges, and every row still meets its successor."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 600)
    rng = random.Random(6)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, H.prose(rng, rng.randint(1, 12))) for i in range(150)] + [(7, "the same")] * 60 + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(((k, t or "", hashes[t]) for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    out = fingerprint.fingerprint(df)
    got = out.collect()
    assert len(got) == len(rows) and out.rdd.getNumPartitions() > 8
    check_fingerprints([(r.doc_id, r.text or "", r.printed) for r in got], [(k, t) for k, t, _ in ordered])


# ------------------------------------------------------------------------------------------------ 8
def test_shards_hold_equal_bytes(spark, docs, empty):
    for df in (docs, clashing(docs), docs.unionByName(docs), spark.createDataFrame([(7, "same")] * 400, "doc_id bigint, text string")):
        out = sharding.shard(df)
        name, by = out.columns[-1], {}
        for r in out.collect():
            by.setdefault(r[name].shard, []).append(r[name])
            assert r[name]["size"] == len((r.text or "").encode()) + 1
        assert sum(map(len, by.values())) == df.count()
        for rows in by.values():
            assert sorted(x.slot for x in rows) == list(range(len(rows)))
        sizes = [sum(x["size"] for x in rows) for rows in by.values()]
        largest = max(x["size"] for rows in by.values() for x in rows)
        assert max(sizes) <= sum(sizes) / 8 + largest
    assert sharding.shard(empty).count() == 0


def test_shard_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry_queries.QUERIES["op8_sharding"](spark, SF).collect():
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8


# ------------------------------------------------------------------------------------------------ 9
def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|start|>x<|message|>y<|end|>", "<~|end|>", "a<", "|end|>", "<<|", "[~INST]", "", None, "é\n<|", "<s></s>", "\\<|end|>"]
    rows = [(c, i, None, "message", ("user", "assistant", None, "<|x\n")[i % 4], hard[(i * 5 + c) % len(hard)]) for c in range(6) for i in range(9)]
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id string, kind string, role string, text string")
    out = chat.render(chat.fold_events(events)).withColumn("turns", chat.parse(F.col("formatted")))
    for r in out.collect():
        want = [(x[4] or "", x[5] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        masked = [r.formatted[s.first : s.first + s.length] for s in r.loss]
        plain = spark.createDataFrame([(m,) for m in masked], "m string").select(chat.unescape(F.col("m")).alias("u")).collect()
        assert [p.u for p in plain] == [t for role, t in want if role == "assistant"]


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "a", "message", "user", "q"), (1, 2, "b", "message", "assistant", ""), (1, 3, "b", "delta", None, "he"), (1, 4, "b", "delta", None, "llo"), (1, 5, "b", "regenerate", "assistant", "by"), (1, 6, "b", "delta", None, "e"),
        (1, 7, "a", "edit", "user", "Q?"), (1, 8, "c", "message", "user", "gone"), (1, 9, "c", "delete", None, None), (1, 10, None, "message", "user", "last"), (2, 1, "z", "delta", "assistant", None),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id string, kind string, role string, text string").repartition(4)
    got = sorted((r.conv_id, r["at"], r.role, r.text) for r in chat.fold_events(events).collect())
    assert got == [(1, 1, "user", "Q?"), (1, 2, "assistant", "bye"), (1, 10, "user", "last"), (2, 1, "assistant", "")]
    assert chat.render(chat.fold_events(events.where("false"))).count() == 0


def test_chat_fold_keeps_roles_and_counts_events_once(spark):
    rows = [
        (1, 1, "a", "message", "assistant", "draft"), (1, 2, "a", "edit", None, "final"), (1, 3, "b", "message", "assistant", "x"), (1, 4, "b", "regenerate", None, ""), (1, 5, "b", "delta", None, "y"),
        (1, 6, "c", "message", "user", "twice"), (1, 6, "c", "message", "user", "twice"), (1, 7, "c", "delta", None, "!"), (1, 7, "c", "delta", None, "!"), (1, 8, "d", "delta", None, "q"), (1, 8, "d", "edit", "user", "e"),
        (1, 9, "e", "edit", "user", "1"), (1, 9, "e", "message", "user", "2"), (None, 1, "n", "message", None, None), (1, 8, "f", "delta", None, "lost role"),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id string, kind string, role string, text string").repartition(3)
    clash = events.select("*", *[F.lit("clash").alias(c) for c in ("at", "base", "deltas", "turns", "formatted", "loss", "n", "before", "head", "body", "span", "turn")])
    out = chat.render(chat.fold_events(clash)).withColumn("said", chat.parse(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].said] == [("assistant", "final"), ("assistant", "y"), ("user", "twice!!"), ("", "lost role"), ("user", "e"), ("user", "2")]
    assert [got[1].formatted[s.first : s.first + s.length] for s in got[1].loss] == ["final", "y"]
    assert [(t.role, t.text) for t in got[None].said] == [("", "")] and got[None].loss == []


def test_chat_query_goes_through_the_fold(spark):
    plan = entry_queries.QUERIES["op9_chat"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regenerate" in plan and "deltas" in plan and "message_id" in plan


# ------------------------------------------------------------------------------------------------ 10
def test_language_on_held_out_rows(spark):
    rows = entry_queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs, empty):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    out, name = language.identify(clashing(docs), model)
    for r in out.collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r[name].lang == "und") != has_letter
    assert language.identify(empty, language.fit(empty))[0].count() == 0
    assert {r.spoken.lang for r in language.identify(docs, language.fit(empty))[0].collect()} == {"und"}


def test_filters_contain_what_was_put_in():
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63, 900)
    f = language.Filters([(f"l{i % 90:02d}", int(x), 1, 10) for i, x in enumerate(h)])
    masks = f.languages(h.view(np.uint64))
    assert all((int(masks[(i % 90) // 64, i]) >> ((i % 90) % 64)) & 1 for i in range(900)) and f.false.max() < 0.01


def plain_grams(text):
    """Runs of four letters of words bounded by one marker on each side."""
    out, word = [], ""
    for c in (text or "").lower() + "\n":
        if c.isalpha():
            word += c
        elif word:
            padded = "\0" + word + "\0"
            out += [padded[i : i + 4] for i in range(len(padded) - 3)]
            word = ""
    return out


def hash_of(gram):
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in gram:
            h = h * np.uint64(0x110003) + np.uint64(0 if c == "\0" else ord(c))
    return int(language.mix64(np.array([h], np.uint64))[0])


def test_grams_and_language_scores_equal_brute_force(spark):
    texts = ["the cat sat on a mat, THE end", "Der Hund läuft über die Straße", "", None, "1 2 3", "a", "ab abc abcd x", "мир и война"]
    hashes, row, has = language.grams(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert sorted(hashes[row == i].tolist()) == sorted(hash_of(g) for g in plain_grams(text))
        assert has[i] == any(c.isalpha() for c in text or "")
    learned = {"en": texts[0], "de": texts[1]}
    counted = []
    for lang, text in learned.items():
        g = plain_grams(text)
        counted += [(lang, int(np.uint64(hash_of(x)).astype(np.int64)), g.count(x), 2 * len(g)) for x in sorted(set(g))]
    model = language.Filters(counted)
    own = {lang: set(plain_grams(text)) for lang, text in learned.items()}
    tried = [texts[0] + " Hund", "Straße cat cat", "zzzz qqqq", "the die"]
    got = model.predict(pa.array(tried))
    for text, lang, score in zip(tried, got["lang"], got["score"], strict=True):
        g, share = plain_grams(text), {}
        for i, x in enumerate(model.langs):
            p = float(model.false[i])
            share[x] = min(1, max(0, (sum(y in own[x] for y in g) / len(g) - p) / (1 - p))) / float(model.coverage[i])
        if max(share.values()) == 0:
            assert score == 0
            continue
        assert lang == max(share, key=lambda x: share[x]) and abs(score - max(share.values()) / sum(share.values())) < 1e-5


# ------------------------------------------------------------------------------------------------ all
def test_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in entry_queries.ORACLES.items():
        got = entry_queries.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null, empty, long, repeated and clashing rows through every stage, each held against what it should keep."""
    import corpus_pipeline as cp

    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = given + [(5000 + r[0], *r[1:]) for r in H.documents()] + given[:3] + [(None, given[9][1], None, None, None)] * 2
    docs = spark.createDataFrame(rows, H.SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("rated", "score", "contamination", "mixed", "copies", "placed", "shard", "slot", "label", "kept", "again", "size")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        rated, at = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")) if name == "quality" else (None, None)
        good = sorted((str(r.doc_id), str(r.text)) for r in rated.where(F.col(f"{at}.score") >= quality.THRESHOLD).collect()) if rated is not None else None
        docs = cp.spool(stage(spark, docs, str(tmp_path)), name)
        after = docs.collect()
        assert len(after) and (docs.columns[: len(columns)] == columns) and (k == len(cp.STAGES) - 1 or docs.columns == columns)
        if name == "quality":
            assert sorted((str(r.doc_id), str(r.text)) for r in after) == good and 0 < len(after) < len(before)
        if name == "mixing":
            times, size = {}, {}
            for r in after:
                times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
            had = {}
            for r in before:
                had[r.doc_id, r.text] = had.get((r.doc_id, r.text), 0) + 1
                size[r.source] = size.get(r.source, 0) + len(H.NONSPACE.findall(r.text or ""))
            assert all(k in had and v <= 3 * had[k] for k, v in times.items())
            taken = {}
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len(H.NONSPACE.findall(r.text or ""))
            wanted = {r.source: r.mixed_.target for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert all(abs(taken.get(s, 0) - t) <= max(10, 0.05 * t) for s, t in wanted.items())
        if name == "sharding":
            shards = {}
            for r in after:
                shards.setdefault(r.shard_, []).append((r.slot_, len((r.text or "").encode()) + 1))
            sizes = [sum(x for _, x in v) for v in shards.values()]
            assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in shards.values()) and sum(map(len, shards.values())) == len(before)
            assert max(sizes) <= sum(sizes) / 8 + max(x for v in shards.values() for _, x in v)
    empty = str(tmp_path / "none")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).where("false").write.parquet(f"{empty}/{t}.parquet")
    assert cp.run(spark, empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, found = docs.columns, H.windows([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cp.spool(stage(spark, docs, SF), name)
        after = [r.doc_id for r in docs.collect()]
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_duplicates":
            want = H.components({i: H.shingles(t) for i, t in before.items()})
            assert sorted(after) == sorted(set(want.values()))
        if name == "decontamination":
            judged = {i: H.contamination(t, found) for i, t in before.items()}
            assert sorted(after) == sorted(i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n))
        if name == "sharding":
            assert sorted(after) == sorted(i for i in after if i in before) and {"shard", "slot"} <= set(docs.columns)
    assert cp.run(spark, SF).count() == len(after)


# ------------------------------------------------------------------------------------------------ repeated rows
def test_two_near_copies_repeated_make_one_pair(spark, monkeypatch):
    """Each of two near copies a thousand times: one pair is verified, one link found, whatever repeats."""
    rng, seen = random.Random(8), []
    base = H.prose(rng, 300).split(" ")
    near = " ".join([*base[:150], "other", *base[151:]])
    rows = [(1, " ".join(base))] * 1000 + [(2, near)] * 1000 + [(3, H.prose(rng, 100))] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    plain = neardup.verify

    def counted(pairs, docs, sets, threshold):
        out = plain(pairs, docs, sets, threshold)
        seen.append((pairs.count(), sets.count(), docs.where("doc_id < 3").count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "verify", counted)
    got = neardup.near_duplicates(df).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, True, 1000), (2, 1, False, 1000), (3, 3, True, 5)]
    assert seen == [(1, 3, 2, 1)]
    kept = neardup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_repeated_benchmark_items_and_long_ones_stay_in_bounded_blocks(spark, docs):
    rng = random.Random(9)
    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 300]
    long_ = " ".join(texts[:4]) + "! " + H.prose(rng, 3000)
    items = [("a", texts[0][:200])] * 100_000 + [("long", long_), ("b", texts[1][50:300]), (None, "one two three"), ("none", None), ("none", "...")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = bench.select(F.coalesce("item_id", F.lit("null")).alias("item"), "text").distinct()
    blocks, keys = decontaminate.item_blocks(plain, 30_000, 13, 4000)
    sizes = [r.s for r in blocks.groupBy("part", "nr").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("s")).collect()]
    assert len(keys) == len(sizes) > 4 and max(sizes) <= 8000
    found = H.windows([("null" if i is None else i, t) for i, t in dict.fromkeys(items)])
    got = decontaminate.decontaminate(docs, bench, block_bytes=4000).select("doc_id", "text", "contamination").collect()
    for r in got:
        n, hit, names = H.contamination(r.text, found)
        assert (r.contamination.n_words, r.contamination.n_hit, sorted(r.contamination["items"])) == (n, hit, names)
    assert any("long" in r.contamination["items"] for r in got)


def test_classifiers_learn_from_ids_however_often_they_repeat(spark):
    """What reaches the driver is bounded by ids and languages, not by rows."""
    rng = random.Random(10)
    rows = [(i, H.prose(rng, 40 + i), ("en", "fr")[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    again = df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(5000)).drop("id"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    once, many = quality.fit(df, labels), quality.fit(again, labels)
    assert once.base == many.base and (once.leaf == many.leaf).all()
    one, two = language.fit(df), language.fit(again)
    assert one.langs == two.langs and (one.masks == two.masks).all()


def test_an_article_outweighs_words_of_any_length():
    said = lambda w, n: " ".join(f"This {w} sentence number {i} has some words in it." for i in range(n))
    story, talk = f"<p>{said('story', 3)}</p>", f"<p>{said('talk', 30)}</p>"
    for page in (
        f"<article>{story}</article><div id='comments'>{talk}</div>",
        f"<main><h1>Title</h1>{story}</main><div class='cookie-consent'>{talk}</div>",
        f"<article>{story}</article><div class='cookie-consent'>{talk}</div>",
        f"<article>{story}<div class='comments'>{talk}</div></article>",
        f"<article>{story}</article><div class='comments'><article>{talk}</article></div>",
    ):
        got = htmltext.main_text(f"<html><body>{page}</body></html>")
        assert got.count("story") == 3 and "talk" not in got
    for page in (  # nothing else has text of its own: the words name the layout
        f"<main><div class='sidebar-layout'>{talk}</div></main>",
        f"<main><h1>Title</h1><div class='sidebar-layout'><article>{talk}</article></div></main>",
        f"<article></article><div class='comment-page'>{talk}</div>",
    ):
        assert htmltext.main_text(f"<html><body>{page}</body></html>").count("talk") == 30


def test_densities_equal_brute_force():
    """Every node's density and sum, from counts that are taken anew for each node."""
    import math

    rng = random.Random(12)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return H.prose(rng, rng.randint(1, 12))
        tag = rng.choice(["div", "p", "a", "span", "section", "b"])
        return f"<{tag}>" + " ".join(grow(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def walk(node):
        yield node
        for x in node.items:
            if isinstance(x, htmltext.Node):
                yield from walk(x)

    chars = lambda x: len("".join(x.split())) if isinstance(x, str) else sum(map(chars, x.items))
    linked = lambda x: 0 if isinstance(x, str) else chars(x) if x.tag == "a" else sum(map(linked, x.items))

    def density(node, root):
        c, t, lc = chars(node), sum(1 for x in walk(node)) - 1, linked(node)
        lt = sum(x.tag == "a" for x in walk(node)) - (node.tag == "a")
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked(root) / max(1, chars(root)) * c + math.e)
        return c / max(1, t) * math.log(max(1.0, c / lc * max(1, t) / max(1, lt))) / math.log(base)

    for _ in range(30):
        root = htmltext.parse(f"<body>{''.join(grow(4) for _ in range(4))}</body>")
        order = htmltext.measure(root)
        for node in order:
            assert node.chars == chars(node) and node.link_chars == linked(node)
            if node.link_chars:
                assert math.isclose(node.density, density(node, root), rel_tol=1e-9)
            own = any(isinstance(x, str) and x.strip() for x in node.items)
            assert math.isclose(node.total, sum(x.density for x in node.items if isinstance(x, htmltext.Node)) + (node.density if own else 0), rel_tol=1e-9)
        best = max(walk(root), key=lambda x: x.total)
        assert any(id(best) == i for i in htmltext.select(root, order)) or best.total == max(x.total for x in order)


def test_a_repeated_row_is_mixed_in_parts(spark, monkeypatch):
    """Most rows repeat one id and text: no window holds them all, and targets are met to a word."""
    monkeypatch.setattr(mixing, "SALTS", 8)
    rows = [(7, "one two three", "a")] * 900 + [(i, "w " * (i % 9 + 1), "b") for i in range(400)] + [(i, "x " * (i % 5 + 1), None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5).cache()
    got = mixing.mix(df).select("source", "doc_id", "mixed.*").collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 3
    copies = [r.copies for r in got if r.source == "a"]
    assert max(copies) - min(copies) <= 1 and sum(copies) == round(next(r.target for r in got if r.source == "a") / 3)


def test_rates_solve_the_dual(spark):
    """The multipliers against a plain bisection of each source's dual."""
    import math

    rng = random.Random(14)
    classes = [(s, n, rng.randint(1, 40)) for s in ("sa", "sb", "sc", "n") for n in sorted(rng.sample(range(1, 400), 25))]
    df = spark.createDataFrame(classes, "src string, size bigint, c bigint")
    for r in mixing.multipliers(df, mixing.source_targets(df)).collect():
        mine = [(n, c) for s, n, c in classes if s == r.src]
        mean = sum(n * c for n, c in mine) / sum(c for _, c in mine)
        words = lambda lam, mine=mine, mean=mean: sum(n * c * min(3.0, math.exp(min(9.0, lam * n / mean))) for n, c in mine)
        if r.target >= 3 * r.source_size * (1 - 1e-12):
            continue
        lo, hi = -60.0 * mean, 60.0 * mean
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < r.target else (lo, mid)
        assert abs(words(r.lam) - r.target) <= 0.02 + 2e-9 * r.target and abs(r.lam - lo) <= 1e-4 * max(1, abs(lo))
