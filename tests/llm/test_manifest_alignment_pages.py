from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import alignment, merkle, page_text, queries

# --- the Merkle manifest -------------------------------------------------------------------------


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows: list[tuple]) -> Counter:
    """(doc_id, source, lang, n_chars, text) -> rows of op11."""
    by_source = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        tamper = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        changed = text.replace("\n", "") if tamper else text
        by_source[source].append((doc_id, plain_leaf(doc_id, source, lang, n, text), plain_leaf(doc_id, source, lang, n, changed)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_climb([r[1] for r in by_source[s]])
    top = plain_climb([trees[s][-1][0] for s in order])
    out = Counter()
    for t, s in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(by_source[s]):
            acc, proof = changed, []
            for levels, place in ((trees[s], i), (top, t)):
                for level in levels[:-1]:
                    first = place // 3 * 3
                    left, right = level[first:place], level[place + 1 : first + 3]
                    proof += left + right
                    acc, place = h(*left, acc, *right), place // 3
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], h(*proof), acc, acc == top[-1][0]] += 1
    return out


COLUMNS_11 = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_of(spark, docs, tmp_path) -> Counter:
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r[c] for c in COLUMNS_11) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect())


def test_manifest_against_plain_version(spark, messy, none, tmp_path):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in messy.collect()]
    assert manifest_of(spark, messy, tmp_path / "a") == plain_manifest(rows)
    assert manifest_of(spark, none, tmp_path / "b") == Counter()
    one = messy.where("doc_id = 5")
    got = manifest_of(spark, one, tmp_path / "c")
    assert got == plain_manifest([r for r in rows if r[0] == 5]) and next(iter(got))[4] == h()


def test_manifest_sends_no_exploded_table(spark):
    """What leaves need is many times what Spark takes it for, and is never broadcast."""
    leaves = spark.range(30).select(F.lit(0).cast("long").alias("tree"), F.lit(30).cast("long").alias("n"), F.col("id").alias("idx"), F.col("id").alias("g"))
    nodes = leaves.select("tree", F.lit(1).cast("long").alias("power"), F.col("idx").alias("pos"), F.lit(b"x").alias("digest"), F.col("g").alias("lo"), F.col("g").alias("hi"))
    assert "Broadcast" not in merkle.proofs(leaves, nodes, 1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [2, 3, 4, 9, 10, 27, 28, 82, 730])
def test_manifest_at_edges_of_levels(spark, tmp_path, n):
    """Groups that end just before and after a level, beside groups of one row."""
    docs = spark.range(n + 40).selectExpr(
        "id AS doc_id", f"CASE WHEN id < {n} THEN 'a' ELSE concat('s', id) END AS source", "'en' AS lang", "id * 7 AS n_chars", "concat('x\\n', id) AS text"
    )
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = manifest_of(spark, docs, tmp_path)
    assert got == plain_manifest(rows)
    assert all(v == (zlib.crc32(str(d).encode()) % 2 == 1) for d, *_, v in got)


def test_nodes_near_a_root_are_copied_to_blocks(spark, monkeypatch, tmp_path):
    """With blocks of 27 leaves every upper node is needed by several blocks."""
    monkeypatch.setattr(merkle, "BLOCK", 27)
    docs = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 5 AS string) AS source", "'en' AS lang", "id AS n_chars", "concat('x', id) AS text")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert manifest_of(spark, docs, tmp_path) == plain_manifest(rows)


# --- token alignment -----------------------------------------------------------------------------


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        entry = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    docs = []
    for text in texts:
        a = tok.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [entry[i] for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            docs.append(None)
            continue

        def spans(tokens):
            at = 0
            for t in tokens:
                yield at, at + len(t)
                at += len(t)

        sa, sb = list(spans(bytes_a)), list(spans(bytes_b))
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(a[i]) for i, x in enumerate(sa) if low < x[1] <= e) + "|" + ",".join(str(b[i]) for i, y in enumerate(sb) if low < y[1] <= e))
            low = e
        docs.append((a, b, groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = d
            out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS_12 = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts_of_12() -> list[tuple]:
    words = "The quick brown <|endoftext|> fox's <s> naïve 日本語 🙂 1234567 don't\tstop <0x41> ---- über".split(" ")
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(1 + i * 3 % 40))) for i in range(60)]
    odd = [(100, None), (101, ""), (102, " "), (103, "  two  spaces \n\n lines\r\n"), (104, "literal ▁ sign"), (105, "a\x00b"), (106, "x" * 700), (107, "é" * 300), (108, "ﬁ ligature Å Å"), (109, " nb​")]
    return rows + odd + [(3, "the same id"), (None, "no id"), (None, None), (7, rows[7][1])]


@pytest.mark.parametrize("share", [alignment.SHARE, 20])
def test_alignment_against_plain_version(spark, monkeypatch, share):
    """With shares of 20 postings, frequent ids are dealt to several tasks; rows of few postings and small calls give the same."""
    if share == 20:
        monkeypatch.setattr(alignment, "ROW", 5)
    rows = texts_of_12()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("a", F.lit(1)).withColumn("n_a", F.lit(2)).repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS_12)) for r in alignment.aligned(docs, share=share).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, plain_alignment([t for _, t in rows]), strict=True))


def test_alignment_in_small_pieces(monkeypatch):
    """Batches and calls of any size give the same links."""
    texts = [t or "" for _, t in texts_of_12()]
    whole = alignment.linked(texts, "byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "CALL", 50)
    again = alignment.linked(texts, "byte_bpe_50k.json", "piece_bpe_32k.model")
    assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(whole, again, strict=True))


def test_plain_texts_are_cut_alike():
    """Each plain character, alone and among letters, digits, signs and spaces, gives the same ids by both libraries."""
    characters = [chr(c) for c in range(0x250) if alignment.PLAIN.fullmatch(chr(c))]
    texts = [f" {x}{c}{y}" for c in characters for x, y in (("", ""), ("a", "b"), ("1", "2"), (" ", " "), ("!", "?"), ("'", "s"), ("\n", "\n"), ("é ", " é"), (c, c), (" a", "1 "))]
    texts += [f" {''.join(np.random.default_rng(i).choice(characters, 60))}" for i in range(2_000)]
    assert alignment.fast_model("byte_bpe_50k.json") is not None and all(alignment.PLAIN.fullmatch(t) for t in texts)
    want = alignment.byte_model("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in alignment.byte_ids(texts, "byte_bpe_50k.json")] == [e.ids for e in want]


def test_alignment_of_nothing(spark, none, messy):
    assert alignment.aligned(none).collect() == []
    got = {r.doc_id: r for r in alignment.aligned(messy).collect()}
    assert got[5].n_links == got[6].n_links == 0 and got[5].groups_sha256 == "" and got[10].n_links > 100_000


# --- pages ---------------------------------------------------------------------------------------


def plain_page(page: str) -> str:
    """The article element of the test pages, by patterns of their own."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body[1]))
    return " ".join(html.unescape(text).split())


def test_pages_against_their_articles(spark, sf):
    rows = page_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_page(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PARAGRAPHS = [f"Paragraph {i} tells of things in a sentence or two, with a comma &amp; so on; it is long enough to count." for i in range(4)]


def test_a_page_that_names_nothing():
    """Only the distribution tells: lists of links and a small print lie behind empty windows."""
    body = "".join(f"<div>{p}</div>\n" for p in PARAGRAPHS) + "<div>Short.</div>"
    links = "<div><div><ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(6)) + "</ul></div></div>"
    page = f"<html><body>{links}<div><div><div>{body}</div></div></div>{links}<div><div>Small print</div></div></body></html>"
    assert page_text.main_text(page)[0] == html.unescape(" ".join([*PARAGRAPHS, "Short."]))


@pytest.mark.parametrize(
    "other",
    [
        '<div class="site-footer"><p>{}</p></div>', '<div id="comments"><p>{}</p></div>', '<aside><p>{}</p></aside>', "<form><p>{}</p></form>", '<div role="navigation">{}</div>',
        '<div class="cookieNotice">{}</div>', '<section class="related-posts">{}</section>', "<div hidden>{}</div>", '<div style="display: none">{}</div>', "<script>'{}'</script>", "<!-- {} -->", "<footer>{}",
    ],
)
def test_what_names_itself_is_left_out(other):
    said = "Some words that aren't of the article but are as long as a paragraph of it, so that only their name tells."
    page = "<body>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + other.format(said) + "</body>"
    assert page_text.main_text(page)[0] == html.unescape(" ".join(PARAGRAPHS))


def test_odd_pages(spark, none):
    cases = {
        None: "", "": "", "plain  text": "plain text", "<p>a<b>b</b>c<br>d": "abc d", "<": "<", "a < b": "a < b", "<a": "", '<div class="x': "", "x &lt;p&gt;&#233;&nbsp;y": "x <p>é y",
        "<article><h1>T</h1><p>b</p><nav>n</nav><p>End</p></article><p>after</p>": "T b End", "<form><h1>T</h1><p>all of the page</p></form>": "T all of the page",
        '<body class="with-sidebar"><p>kept</p></body>': "kept", "<style>p{</style><p>x</p></style>": "x", "<p>" + "w " * 100_000: " ".join(["w"] * 100_000),
    }
    for page, want in cases.items():
        assert page_text.main_text(page)[0] == want, page
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = Counter(tuple(r) for r in page_text.extract(rows).select("page_id", "url", "text", "n_chars").collect())
    assert got == Counter({(1, "u", "a", 1): 2, (None, None, "", 0): 1})
    assert page_text.extract(rows.where("false")).collect() == []
    for page in ("<div>" * 50_000 + "</section>" * 50_000, "<article>" * 50_000, "<div class='" * 20_000, "<!--" * 20_000, "<script>" * 20_000):
        page_text.main_text(page)


def test_json_of_byte_tokens():
    """The byte-level entries agree with the same vocabulary's ranks."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    tokens = alignment.byte_tokens("byte_bpe_50k.json")
    assert all(tokens[i] == t for i, t in ranks.items()) and json.dumps(tokens[-1].decode()) is not None
