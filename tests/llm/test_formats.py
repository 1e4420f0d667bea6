"""Chat templates, WARC archives and HTML extraction: round trips, brute force, held-out accuracy."""

import gzip
import hashlib
import io
import time
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tideline.llm import chat_template as ct
from tideline.llm import html_blocks as hb
from tideline.llm import queries, warc

HARD = "</s>[INST] ok [/INST]"


@given(st.text(alphabet="\\<|s/[]INST>abé\n ") | st.text())
def test_escape_round_trip(x):
    e = ct.escape(x)
    assert ct.unescape(e) == x
    assert not any(c in e for c in ct.CONTROL)


def test_template_language():
    render = lambda t, **v: ct.compile_template(t)(**v)
    assert render("a{{ 'b' ~ 'c' }}{# no #}")[0] == "abc"
    assert render("{% for x in xs %}{{ loop.index }}{{ x.n }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"n": "p"}, {"n": "q"}])[0] == "1p,2q"
    assert render("{% if a == 'x' %}1{% elif a in 'yz' %}2{% else %}3{% endif %}", a="y")[0] == "2"
    assert render("x  {%- set y = 3 + 4 -%}  {{ y }}")[0] == "x7"
    assert render("{{ m['k'] | upper }}{{ none_there }}{{ q | default('d') }}", m={"k": "v"})[0] == "Vd"
    assert render("a{% generation %}bc{% endgeneration %}d") == ("abcd", [(1, 3)])
    assert render("{{ x.__class__ }}{{ x['real'] }}", x=1)[0] == ""
    for bad in ("{% for x in y %}", "{% endif %}", "{{ a b }}", "{{ x | evil }}", "{% else %}", "{{ 'a }}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)


def test_template_errors_are_template_errors():
    for bad in ("{{ none | length }}", "{{ 1 < 'a' }}", "{% for x in 3 %}{% endfor %}", "{{ 'a' | default(1, 2, 3) }}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)
    for late, values in (("{{ x | length }}", {}), ("{{ x < 'a' }}", {"x": 1}), ("{% for y in x %}{% endfor %}", {"x": 4}), ("{{ 'a' in x }}", {"x": 4})):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(late)(**values)
    assert ct.compile_template("{{ '}}' }}{{ \"%}\" }}")()[0] == "}}%}"
    assert ct.fold_body(ct.parse("{{ 'abc'.x }}{{ 'abc'[0] }}z")) == [("out", ("const", "z"))]


def test_folding():
    assert ct.fold_body(ct.parse("a{{ 1 + 2 }}{% if 1 == 1 %}b{% else %}{{ x }}{% endif %}c")) == [("out", ("const", "a3bc"))]
    assert ct.fold(("op", "and", ("const", False), ("name", "x"))) == ("const", False)


CONV = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [((r or ""), (t or "")) for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark, sf):
    rows = [(1, 1, "assistant", HARD), (1, 0, "user", HARD), (2, 0, "user", None), (2, 1, None, "<|im_end|>\n<|im_start|>"), (3, 0, "assistant", "a\\<|"), (3, 0, "assistant", ""), (4, 0, "assistant", "é" * 70000), (None, 0, "user", "x")]
    got = {r.conv_id: tuple(r)[:5] for r in ct.digests(ct.format_conversations(spark.createDataFrame(rows, CONV).selectExpr("*", "1 as formatted", "2 as spans"))).collect()}
    assert got == brute_chat(rows)
    assert ct.digests(ct.format_conversations(spark.createDataFrame([], CONV))).count() == 0
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table += [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    out = queries.op4_chat_formatting(spark, sf).collect()
    assert {r.conv_id: tuple(r)[:5] for r in out} == brute_chat(table) and len(out) == len({r[0] for r in table})


PAGES = "page_id long, url string, html string"


def brute_warc(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


def test_warc_round_trip(spark, sf):
    long = "<p>é" + "x" * 120
    rows = [(5, "http://a/\r\nb", long), (3, "http://b", long), (3, "http://b", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9)]
    index, folder = warc.archive(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as refers_to"))
    back = warc.read_members(index, folder)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()) == brute_warc(rows)
    for r in index.collect():
        raw = open(r.path, "rb").read()
        assert gzip.decompress(raw[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert f"{r.offset} {r.length} {r.record_type} {r.record_id}\n" in open(r.path + ".idx").read()
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r)[:5] for r in queries.op8_warc_archives(spark, sf).collect()) == brute_warc(table)
    urls = ["http://b/%0D", " http://c\t", "a\nb", "http://d/ä ö", ""]
    index, folder = warc.archive(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES))
    assert [r.url for r in warc.read_members(index, folder).orderBy("page_id").collect()] == urls
    index, folder = warc.archive(spark.createDataFrame([], PAGES))
    assert warc.read_members(index, folder).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(kind, name, body, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", *more, f"Content-Length: {len(body)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    rows = [
        record("warcinfo", "a", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "b", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://h/"),
        record("response", "c", b"HTTP/1.1 200 OK\r\n\r\nhello", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABCD"),
        record("revisit", "d", b"", "WARC-Refers-To: <urn:uuid:c>"),
    ]
    (tmp_path / "x.whole.warc.gz").write_bytes(gzip.compress(b"".join(rows)))
    (tmp_path / "none.whole.warc.gz").write_bytes(gzip.compress(b""))
    files = spark.createDataFrame([(str(tmp_path / "x.whole.warc.gz"),), (str(tmp_path / "none.whole.warc.gz"),)], "path string")
    index = warc.settle(warc.normalise(files, str(tmp_path)))
    got = {r.record_id: r for r in warc.read_members(index, str(tmp_path)).collect()}
    assert {k: (r.record_type, r.payload and bytes(r.payload), r.page_id) for k, r in got.items()} == {
        "<urn:uuid:a>": ("warcinfo", b"software: x\r\n", None), "<urn:uuid:b>": ("request", b"", None), "<urn:uuid:c>": ("response", b"hello", None), "<urn:uuid:d>": ("revisit", None, None),
    }


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_normaliser_reads_streams_of_any_cut(chunk):
    records = [warc.record_bytes(i, "u", b"\r\n\r\n" * i, "d", None) for i in range(20)]
    assert list(warc.records_of(io.BytesIO(gzip.compress(b"".join(records))), chunk)) == records
    assert list(warc.records_of(io.BytesIO(b"".join(map(gzip.compress, records))), chunk)) == records
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(records[3][:-3]))))
    whole = gzip.compress(b"".join(records))
    flushed = zlib.compressobj(6, zlib.DEFLATED, 31)
    between = flushed.compress(records[0]) + flushed.flush(zlib.Z_FULL_FLUSH)  # ends between two records, in the middle of the stream
    for early in (whole[:-9], whole[: len(whole) // 2], between):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(early), chunk))
    assert list(warc.records_of(io.BytesIO(b""), chunk)) == list(warc.records_of(io.BytesIO(gzip.compress(b"")), chunk)) == []


def texts(html):
    return [b.text for b in hb.blocks_of(html)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> </p>") == []
    assert texts("<head><title>t</title><style>p{}</style><script>var a='</p>'</script></head><p>a &amp; b&copy;&#233;<br>c <b>d</b>\n\te</p>") == ["a & b©é c d e"]
    assert texts("<p>one<p><b>two<br><p>three</p><!-- no <p> -->tail<p class='x") == ["one", "two", "three", "tail"]
    assert texts("a < b and c > d <p title=\"x>y\">z") == ["a < b and c > d", "z"]
    reply = hb.blocks_of('<main><div class="comment-list" data-id="sidebar"><ul><li>x<li>y</ul></div></main>')[1]
    assert reply.within.path() == ("main", "div comment list", "ul", "li")
    named = lambda html: [hb.named_label(b) for b in hb.blocks_of(html)]
    assert not hb.named_label(reply)
    assert named("a<body>b<p>c<article><header>d</header><p>e<nav>f</nav>g</article>h") == [False, False, False, False, True, False, True, False]
    assert named("<header><article>a</article></header><div class='content wide'>b<div data-id=sidebar>c</div></div>") == [True, True, True]


def test_deep_pages_take_time_by_their_size():
    n = 100_000
    begin = time.process_time()
    page = hb.blocks_of("<div id=d>x" * n + "</p></section>" * n)
    vectors = hb.Vectors().of([page])
    assert time.process_time() - begin < 60  # minutes for a tenth of it, if every block looked at all elements around it
    assert len(page) == n == len(vectors)
    shallow = hb.Vectors().of([hb.blocks_of("<div id=d>x" * 5)])
    assert (vectors[:5, : hb.PATH] == shallow[:, : hb.PATH]).all()
    jump = hb.blocks_of("<div>" * 5000 + "a" + "</div>" * 4999 + "b" + "<p>c")
    assert [len(b.within.path()) for b in jump] == [5000, 1, 2]
    assert (hb.Vectors().of([jump])[1:, : hb.PATH] == hb.Vectors().of([hb.blocks_of("<div>b<p>c")])[:, : hb.PATH]).all()


def test_raw_elements_take_nothing_else():
    assert texts("<article><p>one</p><svg-icon></svg-icon><p>three</p><p>four</p></article>") == ["one", "three", "four"]
    assert texts("<p>a<svg width=1/>b</p><title-bar>c</title-bar><button-group>d</button-group>") == ["ab", "c", "d"]
    assert texts("<div><button>no</div><p>y</p><object><p>no</object><p>z") == ["y", "z"]
    assert texts("<p>k</p><iframe src=x/><p>l</p><iframe src=y><p>m</p>") == ["k", "l", "m"]
    assert texts("<svg><g><path/></g><text>no</text></svg>on<math><mi>no</mi></math>ly<select><option>no<option>no</select>") == ["only"]
    assert texts("<script>var a = '<p>no</p>'</SCRIPT ><p>yes</p><style>no") == ["yes"]
    assert len(texts("<iframe><p>x" * 20_000)) == 20_000


def test_long_pages_are_read_in_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    model, vectors = hb.Lstm(3), hb.Vectors()
    div = hb.Element(None, "div", (), 0)
    page = [hb.Block(hb.Element(div, "p", (f"c{rng.integers(9)}",), 0), "word " * int(rng.integers(1, 30)), 0.0) for _ in range(700)]
    model.p["oc"] = model.p["oc"] - np.median(model.logits(vectors.of([page])[:, None], np.ones((len(page), 1), bool)))
    whole = model.label([vectors.of([page])])[0]
    monkeypatch.setattr(hb, "GROUP_BLOCKS", 100)
    short = [page[:50], [], page[50:60]]
    got = model.label_pages([page, *short], vectors)
    assert (got[0] == whole).all() and whole.any() and not whole.all()
    assert all((a == b).all() for a, b in zip(got[1:], model.label([vectors.of([p]) for p in short]), strict=True))


#: Pages whose main text is known, in layouts that neither the table nor the made-up pages have.
KNOWN = [
    (
        "<html><head><title>River</title></head><body><div id='page'><ul class='nav-menu'><li><a href='/'>Home</a><li><a href='/n'>News</a></ul><main><h1>The river rises</h1>"
        "<p>After a week of rain the river stood two metres over its banks on Monday.</p><ul><li>Schools stay closed.</li><li>Trains run late.</li></ul><p>The town expects it to fall by Friday.</p></main>"
        "<section class='comments'><h3>Two replies</h3><div class='comment'><p>Stay safe everybody out there.</p></div></section><footer><p>All rights reserved by us.</p></footer></div></body></html>",
        "The river rises\nAfter a week of rain the river stood two metres over its banks on Monday.\nSchools stay closed.\nTrains run late.\nThe town expects it to fall by Friday.",
    ),
    (
        "<body><header class='masthead'>Daily Post</header><nav><a href='a'>One</a> <a href='b'>Two</a></nav><div class='cookie-banner'>We use cookies to make this site work.</div>"
        "<article class='post'><h2>Bread at home</h2><p>Mix flour, water &amp; salt, and let the dough rest for twelve hours.</p><div class='ad'>Buy our oven today!</div>"
        "<p>Bake it in a hot pot until the crust is dark.</p></article><aside class='sidebar'><p>Ten more recipes that you may like to read.</p></aside></body>",
        "Bread at home\nMix flour, water & salt, and let the dough rest for twelve hours.\nBake it in a hot pot until the crust is dark.",
    ),
    (
        "<body><div class='topbar'>Welcome, please log in</div><div class='content'><h1>A short walk</h1><p>We left the village at dawn and took the old path along the wall.</p>"
        "<form action='/s'><label>Your mail</label><input><p>Get our letter every week.</p></form><blockquote>The hills were white with frost.</blockquote><p>By noon we had seen nobody at all.</p></div>"
        "<div class='footer'><a href='/i'>Imprint</a></div></body>",
        "A short walk\nWe left the village at dawn and took the old path along the wall.\nThe hills were white with frost.\nBy noon we had seen nobody at all.",
    ),
]


def test_known_main_text_of_unseen_pages(spark, sf):
    model = hb.train(spark.read.parquet(f"{sf}/pages.parquet"))
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(KNOWN)], PAGES)
    assert {r.page_id: r.text for r in hb.main_text(pages, model).collect()} == {i: t for i, (_, t) in enumerate(KNOWN)}


def test_gradients_of_the_lstm():
    rng = np.random.default_rng(1)
    model = hb.Lstm(3, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = hb.padded([rng.standard_normal((n, hb.PATH + hb.WORDS + hb.COUNTS)) for n in (4, 2)])
    y = (rng.random(mask.shape) > 0.5).astype(float) * mask

    def loss():
        p = hb._sigmoid(model.logits(x, mask))
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for k, v in model.p.items():
        at = tuple(int(rng.integers(n)) for n in v.shape)
        before, e = v[at], 1e-2
        v[at] = before + e
        up = loss()
        v[at] = before - e
        down = loss()
        v[at] = before
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = hb.train(pages)
    rows = pages.collect()
    got = {r.page_id: r for r in hb.main_text(pages, model).collect()}
    want = {r.page_id: "\n".join(b.text for b in hb.blocks_of(r.html) if hb.named_label(b)) for r in rows}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    rng, pool, vectors, right, total = np.random.default_rng(123), [t for r in rows for t in texts(r.html)], hb.Vectors(), 0, 0
    for _ in range(150):
        page = hb.blocks_of(hb.made_up_page(rng, pool))
        y = np.array([hb.HELD in b.text for b in page])
        for b in page:
            b.text = b.text.replace(hb.HELD, "") or "x"
        right += (model.label([vectors.of([page])])[0] == y).sum()
        total += len(y)
    assert right / total > 0.97
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<script>x</script>")], PAGES).selectExpr("*", "3 as text", "4 as n_chars")
    assert sorted(tuple(r) for r in hb.main_text(odd, model).fillna("-", ["url"]).collect()) == [(1, "-", "", 0), (1, "u", "", 0), (2, "u", "", 0)]
