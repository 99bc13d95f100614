"""WARC archives, URL filters and HTML extraction."""

import hashlib
import random

from lakequill.llm import html_extract, url_filter, warc
from lakequill.llm.common import Store

PAGE = "page_id long, url string, html string"


class TestWarc:
    def rows(self):
        long = "<p>" + "é" * 60 + "</p>"
        return [(3, "http://b.example.com/x?q#f", long), (1, "https://A.example.com/y", long), (2, None, None), (4, "http://b.example.com/x?q", "short"), (5, "http://b.example.com/x?q", "short"), (6, "", ""), (None, "http://z.org", long), (7, "http://z.org/\r\nX: y", "\x00퟿" * 400), (8, "http://z.org/", "a" * 300_000)]

    def test_round_trip(self, spark):
        got = warc.write(spark.createDataFrame(self.rows(), PAGE), Store(spark, "t"), block_lines=2).captures().collect()
        by = {r.page_id: r for r in got}
        assert len(got) == 9
        for page_id, _, html in self.rows():
            data, r = (html or "").encode(), by[page_id]
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
            assert bytes(r.payload) == (b"" if r.record_type == "revisit" else data)
        assert (by[1].record_type, by[3].record_type, by[3].refers_to) == ("response", "revisit", 1)
        assert [by[i].refers_to for i in (4, 5, 6, 7, 8)] == [None] * 5

    def test_lookup_and_ranges(self, spark):
        rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"page {i}") for i in range(300)]
        archive = warc.write(spark.createDataFrame(rows, PAGE), Store(spark, "t"), block_lines=5)
        asked = spark.createDataFrame([("http://H3.example.com/p3",), ("http://none.example.com/",), ("http://h0.example.com/p49",)], "url string")
        found = sorted(r.page_id for r in archive.lookup(asked).collect())
        assert found == sorted(i for i, u, _ in rows if u in ("http://h3.example.com/p3", "http://h0.example.com/p49"))
        low, high = warc.url_key("http://h2.example.com/"), warc.url_key("http://h3.example.com/")
        assert {r.page_id for r in archive.captures(low, high).collect()} == {i for i, u, _ in rows if low <= warc.url_key(u) < high}

    def test_query_reads_through_both_levels(self, spark, tmp_path, monkeypatch):
        import shutil

        rows = [*self.rows(), *((100 + i, "http://hot.example.com/", f"{i % 9}" * 200) for i in range(400)), *((600 + i, f"http://h{i}.example.com/", None) for i in range(50))]
        pages = spark.createDataFrame(rows, PAGE)
        archive = warc.write(pages, Store(spark, "t"), block_lines=8)
        scan = sorted(map(tuple, archive.captures(payload=False).drop("key").collect()), key=repr)
        found = archive.lookup(pages.select("url"), payload=False)
        assert sorted(map(tuple, found.drop("key").collect()), key=repr) == scan and len(scan) == len(rows)
        assert found.rdd.getNumPartitions() >= 4  # the hot key's blocks are dealt out
        index = archive.root.removeprefix("file://") + "/index"
        names = [n for n in __import__("os").listdir(index) if n.endswith(".directory")]
        assert len(names) == len(archive.shards)
        shutil.move(f"{index}/{names[0]}", tmp_path / "away")
        for read in (archive.captures(), archive.lookup(pages.select("url"))):
            try:
                read.count()
            except Exception:  # noqa: S112
                continue
            raise AssertionError("read without the directory")

    def test_revisits_are_resolved(self, spark):
        pages = spark.createDataFrame(self.rows(), PAGE)
        archive = warc.write(pages, Store(spark, "t"), block_lines=2)
        got = {r.page_id: bytes(r.payload) for r in archive.resolved(archive.captures()).collect()}
        assert got == {i: (h or "").encode() for i, _, h in self.rows()}

    def test_long_payloads_come_in_small_batches(self, spark, tmp_path):
        out, long = warc.FileWriter(f"file://{tmp_path}", "warc.gz"), "x" * (7 << 20)
        lines = [["k", *out.write(warc._compress(warc.record(i, "http://a.org/", long.encode(), hashlib.sha256(long.encode()).hexdigest(), None), warc._GZIP))] for i in range(7)]
        out.close()
        got = [b.num_rows for b in warc._records(warc.RangeReader(f"file://{tmp_path}", "warc.gz"), lines, True)]
        assert got == [3, 3, 1]
        assert [b.num_rows for b in warc._records(warc.RangeReader(f"file://{tmp_path}", "warc.gz"), lines, False)] == [7]

    def test_repeated_rows_and_empty_table(self, spark):
        twice = [(1, "http://a.org/", "x" * 200)] * 2
        assert [r.record_type for r in warc.write(spark.createDataFrame(twice, PAGE), Store(spark, "t")).captures().collect()] == ["response"] * 2
        assert warc.write(spark.createDataFrame([], PAGE), Store(spark, "t")).captures().count() == 0

    def test_url_key(self):
        assert warc.url_key("https://Www.Example.com/a/B?c#d") == "com,example,www)/a/B?c"
        assert warc.url_key(None) == "" and warc.url_key("http://a.org") == "org,a)/"


class TestUrlFilter:
    def brute(self, url, rules):
        host, path = url_filter.host_and_path(url)
        fits = []
        for verdict, rule in rules:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((-len(rule), rule, verdict == "allow"))
        best = min(fits) if fits else None
        return host, path, best and best[1], "allow" if not best or best[2] else "block"

    def urls(self):
        rng = random.Random(6)
        hosts = ["example.org", "m.Example.org", "a.b.example.com", "org", "com", "xorg", "blog.de", "", "example.org:80"]
        paths = ["", "/", "/es/1", "/es", "/en/1", "/en/10", "/EN/1", "/fr/9?x=/de/", "/de/3#a", "/de/"]
        return [rng.choice(["http://", "https://", "://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)] + [None, "", "no scheme/de/", "http:/one.org/"]

    def test_against_brute_force(self, spark):
        rng = random.Random(8)
        more = [(rng.choice(["allow", "block"]), f"{h}{p}") for h in ("example.org", "example.com", "b.example.com", "de", "com") for p in ("/", "/e", "/en/", "/f", "/de/3", "")]
        rows = list(enumerate(self.urls()))
        for rules in (url_filter.RULES, more, [("block", "com/")], []):
            table = spark.createDataFrame(rules, "verdict string, rule string")
            pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
            for most in (1 << 20, 0):
                got = url_filter.judge(pages, table, Store(spark, "t"), max_bytes=most).collect()
                assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: self.brute(u, rules) for i, u in rows}

    def test_cascades_in_parts(self, spark):
        rules = [("allow" if i % 3 else "block", f"h{i}.org/{'p' * (i % 4)}") for i in range(60)] + [("block", "org/pp"), ("allow", "org/pp")]
        rows = list(enumerate(["http://h%d.org/%s" % (i % 90, "p" * (i % 6)) for i in range(400)] + ["http://h1.org/" + "p" * 100_000, None, ""]))
        pages = spark.createDataFrame([(i, u) for i, u in rows], "page_id long, url string")
        table = spark.createDataFrame(rules, "verdict string, rule string")
        got = url_filter.judge(pages, table, Store(spark, "t"), max_bytes=0, part_rules=5).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: self.brute(u, rules) for i, u in rows}

    def test_cascade_is_exact_on_its_universe(self, spark):
        keys = [f"k{i}" for i in range(4000)]
        universe, listed = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (keys, keys[::40]))
        cascade = url_filter.build(universe, listed, Store(spark, "t"), 40)
        assert len(cascade.levels) > 1
        assert cascade.listed(keys).tolist() == [i % 40 == 0 for i in range(4000)]

    def test_empty_table(self, spark):
        rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
        assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules, Store(spark, "t")).count() == 0


class TestHtml:
    page = (
        "<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header><p>Site name</p></header>"
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='cookie-notice'><p>We use cookies on this site.</p><button>OK</button></div>"
        "<!-- c --><article><h1>The  heading</h1><p>First <b>bold</b>&nbsp;text of the story, it goes on.<br>Next line &lt;here&gt;.<p>Second paragraph with a <a href=/x>link</a> in it.</article>"
        "<aside><h3>Related</h3><p>Another story that you may like to read.</p></aside><div class=ad>Buy this thing now.</div>"
        "<section id=comments><h3>Comments</h3><div class=comment><p>I think that this is wrong, and so on.</p></div></section><form><p>Sign up</p><input></form><footer><p>Copyright somebody.</p></footer>"
    )

    def test_page(self):
        assert html_extract.extract(self.page, html_extract.trained()) == "The heading First bold text of the story, it goes on. Next line <here>. Second paragraph with a link in it."

    def test_text_after_scripts_and_options(self):
        said = lambda page: [t for _, t in html_extract.parse(page)[1]]
        for part in (
            "<script>for(i=0;i<n;i++){go()}</script>", "<script>s='<!--'</script>", "<style>a:after{content:'<b'}</style>", "<textarea>a <b c</textarea>", "<SCRIPT>x<y</Script >",
            "<template><script>i<n</script></template>", "<datalist><option value=a><option value=b></datalist>", "<datalist><option>a<p>b</p>c</datalist>", "<div><option>a<div>b</div>c</div>",
        ):
            assert said(f"<p>before</p>{part}<article><p>It goes on.</article>") == ["before", "It goes on."], part

    def written_pages(self):
        """Pages written by hand, apart from the module's own: (html, text of the article)."""
        story = "The river rose by two metres during the night, and the lower town was under water by dawn."
        more = "Nobody was hurt. The mayor said that the old dam had held, as it had in the floods of the last century."
        third = "Repairs to the bridge will take until spring, and buses go round by the hills until then."
        long = f"{story} {more}"
        head = "<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Floods</title><script>for(i=0;i<n;i++){w('<p>')}</script></head>"
        return [
            # main with comments inside, names of classes that no other page has
            (f"{head}<body><div class=topbar><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></div><main><h1>Flood in the valley</h1><p>{story}</p><p>{more}</p><div id=reader-comments><h2>3 replies</h2><p class=comment>I saw it from my window.</p><p class=comment>Terrible news, stay safe everyone.</p></div></main><footer>All rights reserved</footer></body></html>", f"Flood in the valley {long}"),
            # no semantic tags at all
            (f"{head}<body><div id=hd><ul><li><a href=1>News</a><li><a href=2>Maps</a><li><a href=3>Shop</a></ul></div><div id=c1><h2>Valley flooded</h2><p>{long}</p><p>{third}</p></div><div id=sb class=sidebar><h4>Most read</h4><ul><li><a href=4>Ten facts about rain</a><li><a href=5>Where the otters went</a></ul></div></body></html>", f"Valley flooded {long} {third}"),
            # article in wrappers, a promo between paragraphs, a newsletter form after it
            (f"{head}<body class=site><div class=wrap><header class=mast><a href=/>The Valley Post</a><nav><a href=/a>A</a> <a href=/b>B</a></nav></header><div class=grid><article class=entry-x9><h1>After the flood</h1><p>{story}</p><div class='promo sponsored'><p>Buy rubber boots at half the price.</p></div><p>{more}</p><blockquote><p>{third}</p></blockquote></article><form class=newsletter><p>Get our letter every morning.</p><input><button>Join</button></form></div></div><footer><p>Contact us</p></footer></body></html>", f"After the flood {long} {third}"),
            # a cookie notice before everything, a table and a list in the article
            (f"{head}<body><div class=cookie-consent><p>We value your privacy and use cookies on this site.</p><button>Accept</button></div><article><h1>Figures of the flood</h1><p>{story}</p><ul><li>Two metres in one night</li><li>Forty houses damp</li></ul><table><tr><td>Monday</td><td>3 m</td></tr></table></article><section class=comments><h3>Comments</h3><div class=comment><p>Thanks for the figures, they help a lot.</p></div></section></body></html>", f"Figures of the flood {story} Two metres in one night Forty houses damp Monday 3 m"),
            # unclosed paragraphs, an aside inside the article
            (f"{head}<body><nav><ul><li><a href=1>One<li><a href=2>Two</a></ul></nav><article><h1>Dawn<aside class=related><h3>Also read</h3><a href=9>The great drought of last year</a></aside><p>{story}<p>{more}</article><div class=footer-links><a href=7>Imprint</a> <a href=8>Terms</a></div></body></html>", f"Dawn {long}"),
            # an unclosed vector drawing before the article
            (f"{head}<body><header><svg viewBox='0 0 1 1'><path d='M0 0'></header><article><h1>Bridge closed</h1><p>{third}</p><p>{more}</p></article></body></html>", f"Bridge closed {third} {more}"),
        ]

    def test_pages_written_by_hand(self):
        right = [html_extract.extract(page, html_extract.trained()) == text for page, text in self.written_pages()]
        assert all(right), right

    def test_broken_and_bare_pages(self):
        first, second = "The storm reached the coast at noon and tore the roofs off. People hid in cellars.", "By evening the wind had dropped, and the boats went out again."
        story, said = f"<article><h1>Storm at the coast</h1><p>{first}</p><p>{second}</p></article>", f"Storm at the coast {first} {second}"
        replies = "<p>I was there and it was awful, really.</p><p>Me too, but my house is fine.</p>"
        cases = [
            *((f"{x}{story}", said) for x in ("<!-- a --!>", "<!-->", "<!--->", "<!---->", "</ x>", "<?php x ?>", "<![CDATA[ a > b ]]>", "<![CDATA[ a >", "<!x>")),
            (f"<html><body><div class=zq>{first}<br>{second}</div></body></html>", f"{first} {second}"), (f"{first} {second}", f"{first} {second}"),
            (f"<html><head><title>x</title></head><body>{first}<br><br>{second}</body></html>", f"{first} {second}"), (f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{first}<br>{second}</div>", f"{first} {second}"),
            (f'<html><body><nav><a href="x"">Home</a></nav>{story}</body></html>', said), (f"<div title=don't>{story}</div>", said), (f"<div a='>' b=\">\" c=/ >{story}</div>", said), (f"<div ==\"x\" / a>{story}</div>", said),
            (story + f'<div class="kommentare">{replies}</div>', said), (story + f'<section class="commentaires"><h3>2 commentaires</h3>{replies}</section>', said),
            (story.replace("</article>", f'<div class="discussion-thread">{replies}</div></article>'), said),
            (story.replace("</h1>", "</h1><video src=x>Your browser does not support video.</video>"), said), (story.replace("</h1>", "</h1><p><audio controls>No sound here, sorry.</audio></p>"), said),
            (story + "<footer>Copyright</footer><a href='", said),
        ]
        model = html_extract.trained()
        assert [x for x in ((page, html_extract.extract(page, model)) for page, text in cases if html_extract.extract(page, model) != text)] == []

    def test_time_is_linear(self):
        import time

        model = html_extract.trained()
        parts = ['<a "', "<p x='", "b <c ", "<!--", "<![CDATA[", "</x", "<div><tr>", "<td><table>", "<svg><p>", "<x y=", "&amp", "<script>", '<div class="a', "<option>"]
        pages = [x * 60_000 for x in parts] + ["<div>" * 30_000 + x * 30_000 for x in ("</p>", "<li></li>", "<dt>", "</x>")] + ["<td><table>" + "<div>" * 30_000 + "<td></td>" * 30_000, "<svg>" + "<p>" * 30_000 + "<div></div>" * 30_000]
        for page in pages:
            began = time.perf_counter()
            html_extract.extract(page, model)
            assert time.perf_counter() - began < 5, page[:40]

    def test_query_with_clashing_columns(self, spark, tmp_path):
        rows = [(1, "u", "<article><p>It goes on and on, as ever it did.</article>", "x", 5), (1, "u", "<article><p>It goes on and on, as ever it did.</article>", "x", 5), (None, None, None, None, None)]
        spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").write.parquet(str(tmp_path / "pages.parquet"))
        got = sorted(map(tuple, html_extract.op9_html_extract(spark, str(tmp_path)).collect()), key=repr)
        assert got == [(1, "u", "It goes on and on, as ever it did.", 34)] * 2 + [(None, None, "", 0)]

    def test_long_pages(self):
        page = "<html><body><article><h1>Long</h1>" + "".join(f"<p>This is paragraph {i} of a very long page, which goes on.</p>" for i in range(20_000)) + "</article><footer>End</footer></body></html>"
        text = html_extract.extract(page, html_extract.trained())
        assert text.startswith("Long This is paragraph 0 of") and text.endswith("paragraph 19999 of a very long page, which goes on.")

    def test_held_out_pages(self):
        model, wrong, n = html_extract.trained(), 0, 0
        for page, labels in html_extract.labelled_pages(80, 991):
            nodes, _ = html_extract.parse(page)
            p = model.marginals(nodes)
            wrong += sum((x > 0.5) != y for x, y, node in zip(p, labels, nodes, strict=True) if node.own)
            n += sum(1 for node in nodes if node.own)
        assert wrong / n < 0.03

    def test_marginals_are_exact(self):
        from itertools import product
        from math import exp

        model = html_extract.Model({"bias": 0.3, "t:p": 1.1, "t:div": -0.7, "n:few": 0.4}, [[0.5, -0.2], [-0.9, 0.8]])
        nodes, _ = html_extract.parse("<div><p>a b<p>c</div><div><div><p>d</div></div>")
        total, ones = 0.0, [0.0] * len(nodes)
        for states in product((0, 1), repeat=len(nodes)):
            w = exp(sum(model.potential(html_extract.features(n)) for n, s in zip(nodes, states, strict=True) if s) + sum(model.edge[states[n.parent]][s] for n, s in zip(nodes[1:], states[1:], strict=True)))
            total += w
            ones = [o + w * s for o, s in zip(ones, states, strict=True)]
        assert max(abs(o / total - p) for o, p in zip(ones, model.marginals(nodes), strict=True)) < 1e-9

    def test_edge_cases(self, spark):
        rows = [(1, "u", None, "old"), (2, None, "", "old"), (None, "u", "<p>" * 3000 + "deep", "old"), (4, "u", "plain words < 3 & more", "old"), (4, "u", "</p></div>&#233;<", "old")]
        got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), Store(spark, "t")).collect()
        assert len(got) == 5 and [r.text for r in got if r.html in (None, "")] == ["", ""]
        assert html_extract.extract_text(spark.createDataFrame([], PAGE), Store(spark, "t")).count() == 0
