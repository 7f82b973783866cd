"""op7_html on hosts whose pages are long or of several templates."""

import random
import re

from sluice.llm import op7_html as o


def texts(spark, pages):
    made = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in o.extract(made, o.wrappers(made)).collect()}


def test_matches_are_longest(monkeypatch):
    rng = random.Random(3)
    for bits in (1 << 28, 8):
        monkeypatch.setattr(o, "TABLE_BITS", bits)
        for _ in range(300):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            got = o.matches(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))


def test_long_pages_are_matched():
    rng = random.Random(4)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = [x for x in a if x % 7] + [9999]
    assert len(o.matches(a, b)) == len(b) - 1


def test_article_after_long_menu(spark):
    """An unmarked div that varies stands before the article, and a menu that doesn't fold between them."""
    rng = random.Random(5)
    menu = "".join(f"<li class=k{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}q{chr(97 + i % 26)}{chr(97 + i // 26)}>entry</li>" for i in range(300))
    pages = [(i, "https://long.example.com/x", f"<body><div class=top>hello {'xyz'[i % 3] * (i + 3)}</div><ul>{menu}</ul><article><p>{'own words ' * 30}{i}</p></article></body>") for i in range(5)]
    got = texts(spark, pages)
    assert all(got[i] == f"{'own words ' * 30}{i}" for i in range(5))


def test_long_texts_differ_after_their_beginning():
    a, b = (o.stream(f"<div>{'the same beginning ' * 10}{x}</div>") for x in "ab")
    assert o.infer([a, b])[1][0] == "slot" and o.infer([a, a])[1][0] == "text"


def test_every_template_has_its_region(spark):
    """Of 60 pages three are of a second template, which uses the first one's region for something short."""
    pages = [(i, "https://two.example.com/x", f"<body><div class=top>same</div><div class=text><p>{'words of it ' * 20}{i}</p></div></body>") for i in range(57)]
    pages += [(i, "https://two.example.com/y", f"<body><div class=text>label</div><div class=body><h2>t{i}</h2><p>{'other words ' * 20}{i}</p></div></body>") for i in range(57, 60)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = o.wrappers(made).collect()
    assert sorted((r.region, r.pages) for r in found) == [("div.body", 3), ("div.text", 60)]
    got = texts(spark, pages)
    assert all(got[i] == f"{'words of it ' * 20}{i}" for i in range(57)) and all(got[i] == f"t{i}\n\n{'other words ' * 20}{i}" for i in range(57, 60))


def test_one_long_page_does_not_decide(spark):
    page = lambda i, side: f"<body><div class=own><p>{'words of it ' * 20}{i}</p></div><div class=extra>{side}</div></body>"
    got = texts(spark, [(i, "https://odd.example.com/x", page(i, "x" * 50_000 if i == 3 else f"by {i}")) for i in range(40)])
    assert all(got[i] == f"{'words of it ' * 20}{i}" for i in range(40))


def test_merges_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(o, "FAN", 2)
    rng = random.Random(6)
    pages = [(i, "https://many.example.com/x", "<body>" + "".join(f"<div class={rng.choice('abcde')}>{rng.choice(['fixed', str(i)])}</div>" for _ in range(rng.randint(1, 12))) + f"<article><p>text {i}</p></article></body>") for i in range(80)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    first, second = (sorted(map(str, o.wrappers(made.repartition(n)).collect())) for n in (1, 7))
    assert first == second


def test_region_by_its_place(spark):
    """No element has a telling name: the wrapper alone tells the article, which is the second div, from the first."""
    side = "<div><h3>Elsewhere</h3><a href=/x>one</a></div>"
    pages = [(i, "https://plain.example.com/x", f"<body>{side}<div><h2>title {i}</h2><p>{'own words ' * 20}{i}</p><em>All rights kept by the site</em></div><div><a href=/y>end</a></div></body>") for i in range(12)]
    got = texts(spark, pages)
    for i in range(12):
        assert got[i].startswith(f"title {i}\n\n{'own words ' * 20}{i}") and "Elsewhere" not in got[i] and "end" not in got[i] and got[i].endswith("All rights kept by the site")
    bare = {i: o.main_text(h, "") for i, _, h in pages}
    assert all("Elsewhere" in x for x in bare.values())  # what there is without the wrapper
    assert texts(spark, pages[:7]) == {i: got[i] for i in range(7)}  # whatever the number of pages


def test_class_words_within_a_region(spark):
    """What a class word marks goes where the wrapper holds it fixed, and stays where it varies as the text does."""
    def page(i, tag):
        return f"<body><div class=share><p>outer</p></div><{tag}><p>{'own words ' * 20}{i}</p><section class=related-work><p>two {i}</p></section><div class=share><b>tell</b> friends</div><section class=comments><p>reader {i}</p></section><p>end {i}</p></{tag}></body>"

    pages = [(10 * k + i, f"https://words{k}.example.com/x", page(i, tag)) for k, tag in enumerate(("article", "div class=own")) for i in range(9 - k)]
    pages = [(i, u, h.replace("</div class=own>", "</div>")) for i, u, h in pages]
    want = {10 * k + i: f"{'own words ' * 20}{i}\n\ntwo {i}\n\nend {i}" for k in range(2) for i in range(9 - k)}
    assert texts(spark, pages) == want
    one = texts(spark, [(0, "https://alone.example.com/x", page(0, "article"))])[0]  # one page tells nothing of what is fixed
    assert "two 0" in one and "tell friends" in one and "reader" not in one and "outer" not in one


def test_wrappers_decide_and_equal_brute_force(spark):
    """Hosts whose elements have no telling names: the innermost block around all texts that vary, found by comparing pages place by
    place, holds the main text; without wrappers each page would be taken whole."""
    rng = random.Random(17)
    pages, want = [], {}
    for host in range(6):
        before, inner, after = (rng.randint(1, 4) for _ in range(3))
        fixed = lambda n, w: [f"<div><p>{w} {k} of host {host}</p></div>" for k in range(n)]
        heads, tails = fixed(before, "top"), fixed(after, "low")
        for i in range(rng.choice([3, 7, 20])):
            parts = [f"part {k} on page {i} {'text ' * (k + 3)}".strip() for k in range(inner)]
            body = "<h2>Summary</h2>" + "".join(f"<p>{p}</p>" for p in parts)
            key = 100 * host + i
            pages.append((key, f"https://brute{host}.example.com/{i}", f"<body>{''.join(heads)}<section><div>{body}</div></section>{''.join(tails)}</body>"))
    cut = re.compile(r"<[^>]*>")
    for host in range(6):  # brute force: every page of a host has the same tags here, so places compare directly
        own = [(k, cut.split(h), cut.findall(h)) for k, u, h in pages if f"brute{host}." in u]
        assert len({tuple(t) for _, _, t in own}) == 1
        varying = [j for j in range(len(own[0][1])) if len({x[j] for _, x, _ in own}) > 1]
        tags, stack, spans = own[0][2], [], []
        for j, t in enumerate(tags):
            if t.startswith("</"):
                spans.append((stack.pop(), j))
            else:
                stack.append(j)
        low, high = max(((s, e) for s, e in spans if s < varying[0] and e >= varying[-1] and tags[s][1:4] in ("div", "sec")), key=lambda x: x[0])
        for k, x, _ in own:
            want[k] = "\n\n".join(y.strip() for y in x[low + 1 : high + 1] if y.strip())
    got = texts(spark, pages)
    assert got == want
    assert all(o.main_text(h, "") != got[k] for k, _, h in pages)


def test_fixed_texts_of_articles_stay(spark):
    pages = [(i, "https://named.example.com/x", f"<body><article><h2>Summary</h2><p>{'own words ' * 20}{i}</p></article></body>") for i in range(12)]
    assert all(t.startswith("Summary\n\n") for t in texts(spark, pages).values())


def test_wrappers_that_are_joined(spark, monkeypatch):
    pages = [(i, f"https://h{i % 3}.example.com/x", f"<body><div><b>menu</b></div><div><h2>t{i}</h2><p>{'own words ' * 20}{i}</p></div></body>") for i in range(30)]
    want = texts(spark, pages)
    assert all(want[i].startswith(f"t{i}\n\nown") for i in range(30))
    monkeypatch.setattr(o, "MAX_BYTES", 0)
    assert texts(spark, pages) == want


def test_places_follow_folding():
    page = "<body><div><p>a</p><p>b</p><p>c</p></div><section>x</section></body>"
    elements, at = o.placed(page)
    kinds = [o.shape(e) for e in elements]
    tokens = list(o.tokens(page))
    assert len(at) == len(elements) and at == sorted(at)
    assert tokens[at[kinds.index("tag:section")]].name == "section"


def test_texts_by_construction(spark):
    """Random pages of several hosts whose main text is known from how they are put together."""
    import html

    rng = random.Random(21)
    word = lambda: rng.choice(["alpha", "b&c", "d<e", "naïve", "日本", "x\u00a0y", "word"])
    text = lambda n: " ".join(word() for _ in range(rng.randint(3, n)))
    plain = lambda t: " ".join(t.split())
    junk = lambda: rng.choice(["<nav><ul><li>menu</li></ul></nav>", "<aside>side</aside>", "<div class='ad'>buy</div>", "<form><p>name</p></form>", "<script>if (a<b) '</p>'</script>", "<!-- <p>gone</p> -->", "<style>p{}</style>", "<div class=cookie-notice>c</div>", "<section class='comments'><p>reader</p></section>"])

    def inside():
        made, blocks = [], []
        for _ in range(rng.randint(2, 9)):
            t = text(40)
            kind = rng.randrange(5)
            if kind == 0:
                made.append(junk())
                continue
            body = html.escape(t)
            if kind == 1:
                half = len(t.split(" ")) // 2
                a, b = " ".join(t.split(" ")[:half]), " ".join(t.split(" ")[half:])
                made.append(f"<p>{html.escape(a)} <b>{html.escape(b)}</b>\n")
            elif kind == 2:
                items = [text(6) for _ in range(rng.randint(1, 4))]
                made.append("<ul>" + "".join(f"<li>{html.escape(x)}" for x in items) + "</ul>")
                blocks += map(plain, items)
                continue
            else:
                made.append(f"<{'p' if kind == 3 else 'h2'}>\n  {body}</{'p' if kind == 3 else 'h2'}>")
            blocks.append(plain(t))
        return "".join(made), blocks

    pages, want = [], {}
    for i in range(90):
        host = i % 4
        body, blocks = inside()
        main = [f"<article>{body}</article>", f"<main><div class=post>{body}</div></main>", f"<div class=wrap><h4>Site</h4></div><div class=story-text>{body}</div>", f"<section><em>top</em></section><section>{body}</section>"][host]
        page = f"<html><head><title>t</title></head><body><header><p>head</p></header>{junk()}{main}<footer>end</footer></body></html>"
        pages.append((i, f"https://h{host}.example.com/{i}", page))
        want[i] = "\n\n".join(blocks)
    got = texts(spark, pages)
    assert {i: t for i, t in got.items() if want[i]} == {i: t for i, t in want.items() if t}
