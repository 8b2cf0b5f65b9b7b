"""Language ID, toxicity, mixing, coding, pages and neighbours."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import html_text, language_id, mixing, neighbours, queries, sentencepieces, token_files, toxicity

from ..conftest import DATA

MEDIUM = "/root/testdata/sf0.01"
PIECES, BPE = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.json")
ODD_TEXTS = [None, "", " ", "a", "  a  b ", "日本語 テスト\n\n 😀x", "\n", "tab\tx \x00", "x\n y", "a\x85 b", "it's <|endoftext|> ok's", "É's über-alles!! x1 q~", "word " * 2000, "a" * 5000]


def test_language_held_out(spark):
    got = {r.doc_id: r for r in queries.queries()["op5_language_id"](spark, MEDIUM).collect()}
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if got[r.doc_id].held_out]
    assert len(got) == len(rows) and np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the cat and the dog"), (4, "the cat and the dog"), (5, "Привет мир"), (None, "the")]
    profiles = language_id.fit(docs([(10, "the cat sat on the mat with the hat"), (11, None)]))
    got = sorted(((r.doc_id or 0), r.lang_pred) for r in language_id.predict(docs(rows), profiles).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    assert {r.lang_pred for r in language_id.predict(docs(rows), language_id.fit(docs([]))).collect()} == {"und"}
    assert language_id.predict(docs([]), profiles).count() == 0


def test_ordinal_fit():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 12)) < 0.2).astype(float)
    z = x @ np.r_[3.0, 2, -2, np.zeros(9)] + rng.logistic(size=3000)
    w, t = toxicity.fit_ordinal(x, (z > 1).astype(int) + (z > 3), 3)
    assert np.allclose(w[:3], [3, 2, -2], atol=0.45) and np.abs(w[3:]).max() < 0.4 and np.allclose(t, [1, 3], atol=0.3)


def insults(rng, i):
    own = [f"w{rng.randrange(300)}" for _ in range(40)]
    bad = i % 4 == 0
    if bad:
        own[rng.randrange(40)] = rng.choice(["idiot", "scum", "clown"])
    return " ".join(own), bad


def test_toxicity(spark, docs):
    rng = random.Random(2)
    made = [(i, *insults(rng, i)) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(b) if i % 50 else 1 - int(b)) for i, _, b in made[:800]] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    rows = [(i, t) for i, t, _ in made] + [(2000, None), (2001, ""), (2002, "You IDIOT!"), (2002, "You IDIOT!"), (None, "scum of the earth")]
    got = toxicity.toxicity(docs(rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].toxic == b for i, _, b in made) and by[2002].toxic and by[None].toxic and not by[2000].toxic and not by[2001].toxic
    assert all(0 <= r.severity <= 2 and (r.grade > 0) == r.toxic for r in got)
    empty = toxicity.toxicity(docs(rows[:5]), labels.filter("false")).collect()
    assert not any(r.toxic for r in empty) and toxicity.toxicity(docs([]), labels).count() == 0


def test_toxicity_keeps_columns(spark):
    df = spark.createDataFrame([(1, "fine words", "a", True), (2, "idiot", "b", False)], "doc_id long, text string, severity string, toxic boolean")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.keep_documents(df, labels).collect()) == sorted(df.collect())


def filled(sizes):
    total, weight = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 99))
    target, rest, free = {}, float(total), set(sizes)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


def test_mixing(docs):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(0, 60), rng.choice(["a", "b", "b", "b", "é", None, "z"])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "only"), (1, rows[1][1], rows[1][2]), (None, "x y z", "a")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    taken = {}
    for r in got:
        key = next(s for s in sizes if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6)
        taken[key] = taken.get(key, 0) + r.taken
    assert all(abs(taken.get(s, 0) - want[s]) <= 0.01 * want[s] + 3 for s in sizes)
    again = mixing.mix(docs(list(reversed(rows)))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)
    out = mixing.mixed_documents(docs(rows))
    assert out.count() == sum(r.copies for r in got if r.taken) and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.mix(docs([])).count() == 0


def test_mixing_prefers_weight(docs):
    rows = [(i, "word " * 10, "a" if i < 300 else "b") for i in range(600)]
    got = mixing.mix(docs(rows), quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).collect()
    more = [r.copies for r in got if r.doc_id >= 300 and r.doc_id % 2 == 0]
    less = [r.copies for r in got if r.doc_id >= 300 and r.doc_id % 2]
    assert np.mean(more) > np.mean(less) + 0.3


def brute(model, text):
    best = [(0.0, [])] + [None] * len(text)
    pieces = {p: (i, s) for i, p, s in model.pieces}
    least = min(s for _, _, s in model.pieces) - 10
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in pieces:
                i, s = pieces[piece]
                found = (best[start][0] + s, [*best[start][1], i])
            elif end - start == 1:
                found = (best[start][0] + least, best[start][1] + [model.byte_ids[b] for b in piece.encode()])
            else:
                continue
            if best[end] is None or found[0] > best[end][0]:
                best[end] = found
    return best[-1]


def test_pieces_are_the_best_path():
    model = sentencepieces.load_model(PIECES)
    coder = sentencepieces.Encoder(model)
    rng = random.Random(1)
    score = {i: s for i, _, s in model.pieces}
    least = min(score.values()) - 10
    for text in ["the heon to, of nd", "日本 x", " a  b", "Ünï\tq", *("".join(rng.choice("abet hn.▁ ") for _ in range(30)) for _ in range(30))]:
        ids = coder.encode(text).tolist()
        want, _ = brute(model, "▁" + text.replace(" ", "▁"))
        chars = {c for c in text if c not in coder.singles and c != " "}
        got = sum(score.get(i, 0.0) for i in ids) + least * sum(text.count(c) for c in chars)
        assert got == pytest.approx(want) and coder.decode(ids) == text.replace("▁", " ")


def test_pieces_match_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(PIECES, "rb") as f:
        spec = proto.ModelProto.FromString(f.read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        p.score = max(p.score, -40000.0)
    sp = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    base = sentencepieces.load_model(PIECES)
    model = sentencepieces.Model([(i, p, max(s, -40000.0)) for i, p, s in base.pieces], base.byte_ids, base.unknown, base.decoded, True, "test")
    coder = sentencepieces.Encoder(model)
    for text in ["the heon to, of nd", "Ünï q", "日本語 x", "a  b", "hello\nworld again"]:
        assert coder.encode(text).tolist() == sp.encode(text)


def test_pieces_are_those_of_the_models_type(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = sentencepieces.encoder(sentencepieces.load_model(PIECES))
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(100).collect()
    for text in ["the approval of generated words", *[t for t in ODD_TEXTS if t], *[r.text for r in rows if r.text]]:
        assert coder.encode(text).tolist() == sp.encode(text)


def test_neighbouring_pieces_agree_as_the_merges_do():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = sentencepieces.encoder(sentencepieces.load_model(PIECES))
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("abstmdrevlSon  '\n\t09.,-é×日😀\u3000|_▁") for _ in range(rng.randrange(40)))
        assert coder.encode(text).tolist() == sp.encode(text)


def test_pieces_memory_is_bounded(monkeypatch):
    """What a worker remembers stays within its bounds, and the ids don't depend on what it remembers."""
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "UNITS", 200, raising=False)
    monkeypatch.setattr(sentencepieces, "PAIRS", 300, raising=False)
    coder = sentencepieces.MergeEncoder(sentencepieces.load_model(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeilmnorstuéß日") for _ in range(rng.randrange(3, 12))) for _ in range(600)]
    for at in range(0, len(words), 25):
        text = " ".join(words[at : at + 25])
        assert coder.encode(text).tolist() == library.encode(text)
    assert 100 < len(coder.pool.number) <= 200
    assert 0 < len(coder.agreed) <= 300


def test_pieces_table(docs):
    got = {r.doc_id: r for r in sentencepieces.encode_documents(docs(list(enumerate(ODD_TEXTS))), PIECES).collect()}
    coder = sentencepieces.Encoder(sentencepieces.load_model(PIECES))
    for i, t in enumerate(ODD_TEXTS):
        assert got[i].round_trip and got[i].n_tokens == len(got[i].ids) and coder.decode(np.array(got[i].ids, dtype=np.int64)) == (t or "")
    assert sentencepieces.encode_documents(docs([]), PIECES).count() == 0


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BPE)
    rows = [(100 - i, t) for i, t in enumerate(ODD_TEXTS)] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(token_files.token_files(docs(rows), BPE).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = made.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(docs([]), BPE).count() == 0
    twice = sorted(token_files.token_files(docs([(None, "x"), (1, "y"), (1, "y")]), BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in twice] == [None, 1, 1]


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    with open(BPE, encoding="utf-8") as file:
        spec = file.read()
    made = Tokenizer.from_str(spec)
    assert token_files.encode_texts(["a <|endoftext|> b"], spec, None)[0].tolist() == [64, 220, 50256, 275]
    rng = random.Random(5)
    signs = list("abstmdrevlS  '''\n\t09.,-é×÷ª日😀\u3000\xa0ß|_")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["x's 's 'S ''s a'll 've'd", "\n\n x", "'re", "a'réx", "a  ", "  a"]
    assert [x.tolist() for x in token_files.encode_texts(texts, spec, None)] == [made.encode(t, add_special_tokens=False).ids for t in texts]
    other = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    assert [x.tolist() for x in token_files.encode_texts(["A cat <|endoftext|>", None, ""], other.to_str(), 7)] == [[*other.encode("A cat <|endoftext|>", add_special_tokens=False).ids, 7], [7], [7]]


def test_token_files_with_clashing_columns(spark):
    df = spark.createDataFrame([(2, "b c", "x", 1), (1, "a", "y", 2)], "doc_id long, text string, tie string, start long")
    assert sorted((r.doc_id, r.start) for r in token_files.token_files(df, BPE).collect()) == [(1, 0), (2, 2)]


def test_id_files_have_random_access():
    rng = np.random.default_rng(0)
    docs_ = [rng.integers(0, 2 ** rng.integers(1, 32), rng.integers(0, 2000), dtype=np.uint64).astype(np.uint32) for _ in range(30)]
    file = token_files.open_ids(token_files.pack_ids(list(range(30)), docs_))
    every = np.concatenate(docs_)
    assert all((file.document(k) == d).all() for k, d in enumerate(docs_)) and (file.ids(0, file.n_ids) == every).all()
    assert all(file.ids(i, i + 1)[0] == every[i] for i in rng.integers(0, len(every), 200).tolist())
    assert token_files.open_ids(token_files.pack_ids([], [])).n_ids == 0


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header class="top"><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav><div id="cookie-bar">We use cookies</div>
<div class="sidebar">Side</div><div class="siteHeader">Brand</div><p style="display: none">unseen</p><article><header><h1>T&eacute;st</h1></header><p>One<b>two</b> three&nbsp;x<p>Four &lt;b&gt;<br>five<ul><li>a<li>b</ul><form><label>Mail</label></form>
<section id="comments"><article class="comment">hey</article></section></article><aside>z</aside><footer>f</footer></body></html>"""


def test_main_text():
    parsed = html_text.parse(PAGE)
    assert html_text.main_text(parsed) == "Tést Onetwo three x Four <b> five a b"
    assert html_text.main_text(html_text.parse(None)) == html_text.main_text(html_text.parse("")) == ""
    assert html_text.main_text(html_text.parse("plain < text &amp; more")) == "plain < text & more"
    assert html_text.main_text(html_text.parse("<div>" * 3000 + "deep")) == "deep"


def test_site_style_tree(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        body = " ".join(f"w{rng.randrange(999)}" for _ in range(30))
        rows.append((i, f"http://Site.example/{i}", f"<body><div class='x1'>Welcome to our site</div><div class='x2'><p>{body}</p></div><div class='x3'><p>Call us now</p></div></body>"))
    rows += [(20, "http://one.example/", "<body><div class='x1'>Welcome to our site</div></body>"), (21, None, rows[0][2]), (22, "http://site.example/q", None), (0, rows[0][1], rows[0][2])]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows[:12]:
        assert got[i].text == re.search(r"<p>(w.*?)</p>", h)[1] and got[i].n_chars == len(got[i].text)
    assert got[20].text == "Welcome to our site" and "Call us now" in got[21].text and got[22].text == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_low_branches_far_up(spark):
    rng = random.Random(4)
    deep = "<div>" * 70 + "Terms of our house" + "</div>" * 70
    rows = [(i, f"http://deep.example/{i}", f"<body><div class='q1'>{deep}</div><div class='q2'><p>{rng.random()}</p></div></body>") for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(re.fullmatch(r"0\.\d+(e-\d+)?", r.text) and (r.n_blocks, r.n_low, r.n_named) == (2, 1, 0) for r in got)


def test_the_tree_changes_pages_that_no_list_names(spark):
    """Boilerplate under class names that no list has: the rules keep all of it, the tree removes it from every page."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for h in range(5):
        top, end = f"<div class='k{h}a'><ul><li>{words(3)}<li>{words(2)}</ul></div>", f"<div class='k{h}z'><p>{words(9)}</p><span>{words(4)}</span></div>"
        for i in range(30):
            want[h * 100 + i] = words(40)
            rows.append((h * 100 + i, f"https://h{h}.example/{i}", f"<html><body>{top}<div class='k{h}m'><p>{want[h * 100 + i]}</p></div>{end}</body></html>"))
    assert not any(html_text.main_text(html_text.parse(h)) == want[i] for i, _, h in rows)
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_low >= 4 and r.n_named == 0 for r in got)


def test_parser_takes_time_in_proportion(spark):
    import time

    for page in ("<b></i>" * 20_000, "<li><button>" + "<b>" * 5_000 + "<li></li>" * 5_000, "<div>" * 20_000 + "deep", "<p>" * 20_000, "<p>long text " * 50_000):
        began = time.process_time()
        html_text.main_text(html_text.parse(page))
        assert time.process_time() - began < 10


def test_pages_odd_rows(spark):
    rows = [(1, None, None, "h", [1]), (None, "http://a.example/", "<p>x</p>", "h", [2]), (2, "http://a.example/", "", "h", [3]), (2, "http://a.example/", "", "h", [3]), (3, "::", "<p>a <span class='ad'>buy</span> b</p><p>" + "long " * 100_000, "h", [4])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, low array<int>").withColumn("row_id", F.lit(1)).withColumn("text", F.lit("t"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got[:4] == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)] and got[4][1] == "a b " + "long " * 99_999 + "long"


def test_same_article_on_a_host_stays(spark):
    rows = [(i, "http://h.example/a", f"<nav>{i}</nav><article><h1>T</h1><p>the same article everywhere</p></article>") for i in range(9)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"T the same article everywhere"}


def test_pages_table(spark):
    import html

    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.queries()["op1_html_main_text"](spark, DATA).collect()}
    for r in rows:
        a = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?:br|/?p|/?h1)>", " ", a))).split())


def test_neighbours(spark):
    rows = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in queries.queries()["op10_additive_neighbours"](spark, MEDIUM).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = sorted(got[q])
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {v for _, v, _ in best}) / 10)
        assert [r for r, _, _ in best] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in best)
    assert np.mean(hits) >= 0.9


def test_neighbours_clustered_and_exact(spark):
    """Dense groups of over a thousand close vectors; with all candidates the search is brute force."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([centres[i % 6] + rng.normal(size=16) * (1e-3 if i % 6 < 2 else 0.3) for i in range(9000)]).reshape(9000, 16)
    x[5000:5020] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("query_id", F.lit(1)).withColumn("vector", F.lit(2))
    for rerank, least in ((neighbours.RERANK, 0.9), (9000, 1.0)):
        got: dict = {}
        for r in neighbours.search(df, every=300, rerank=rerank).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        hits = []
        for q in range(0, 9000, 300):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            hits.append(len(set(np.lexsort((np.arange(9000), d))[:10].tolist()) & {v for _, v in got[q]}) / 10)
        assert len(got) == 30 and np.mean(hits) >= least


def test_neighbours_of_many_groups(spark, monkeypatch):
    """Groups of queries beyond the bound of a broadcast meet the parts of the blocks; with blocks ranked whole the scores are exact to the last bit."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 40)
    monkeypatch.setattr(neighbours.common, "BROADCAST_BYTES", 0)
    x = np.random.default_rng(9).normal(size=(1500, 24))
    x[700:715] = x[3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got: dict = {}
    for r in neighbours.search(df, every=3, rerank=9000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 500
    for q in range(0, 1500, 3):
        d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        d[q] = np.inf
        order = np.lexsort((np.arange(1500), d))[:10]
        assert sorted(got[q]) == [(j + 1, int(v), float(d[v])) for j, v in enumerate(order)]


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [3.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (100, [3.0, 2.0]), (None, [1.0, 1.0]), (200, [1.0]), (201, [2.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 3.0), (100, 1, 3, 1.0), (100, 2, 0, pytest.approx(10**0.5)), (100, 3, 1, pytest.approx(10**0.5)), (200, 1, 201, 1.0)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
