"""WARC archives and main text."""

import base64
import hashlib
import json
import random

import pytest

from blockmatch.llm import html_text, warc, wrappers
from blockmatch.llm.pagetokens import tokens
from blockmatch.llm.wrappers import Wrapper, align, dumps, fold

PAGES = [(1, "http://a/1", "same"), (2, "http://a b/2\n", "same"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é" * 50_000 + "\r\n\r\n0\r\n\r\n"), (6, "http://a/6", "WARC/1.1\r\n\r\n"), (None, "http://a/7", "same"), (7, "u", "x"), (7, "u", "x")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("segment", [200, 32 << 10])
def test_archives_round_trip(spark, tmp_path, segment):
    path = str(tmp_path / "out")
    warc.write_archives(pages(spark, PAGES), path, segment=segment, records_per_file=3)
    found = warc.read_archives(spark, path, with_payload=True).cache()
    assert found.where("problem is not null").count() == 0
    held = {r["record_id"]: bytes(r["payload"]).decode() for r in found.where("record_type = 'response'").collect()}
    assert sorted(held.values()) == sorted({h or "" for _, _, h in PAGES})
    out = sorted((tuple(r)[:5] for r in warc.archive_report(found).collect()), key=str)
    largest = {}
    for i, _, h in PAGES:
        largest[h or ""] = max(x for x in (i, largest.get(h or "")) if x is not None)
    want, seen = [], set()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = i == largest[h or ""] and i not in seen
        seen |= {i} if first else set()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else largest[h or ""]))
    assert out == sorted(want, key=str)


def test_archives_of_nothing_and_least_size(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []
    warc.write_archives(pages(spark, PAGES), str(tmp_path / "least"), min_bytes=5)
    found = warc.read_archives(spark, str(tmp_path / "least"))
    assert found.where("record_type = 'response'").count() == len(PAGES)


def test_broken_segments_are_named(spark):
    records = list(warc.page_records("12345678-1234-5678-1234-567812345678", 1, 1, "u", b"y" * 1000, None, 100))
    assert len(records) > 5
    decoder = warc.Unframe()
    whole = warc.HTTP + warc.frame(b"abc" * 5000)
    rng, at = random.Random(1), 0
    while at < len(whole):
        n = rng.randrange(1, 700)
        decoder.feed(whole[at : at + n])
        at += n
    assert decoder.close() is None and decoder.size == 15000 and decoder.sha.digest() == hashlib.sha1(b"abc" * 5000).digest()
    early = warc.Unframe()
    early.feed(whole[:-20])
    assert early.close() == "message ends early"
    run = warc._reassemble(False)
    rows = [{"origin": "o", "record_id": "o", "segment": k + 1, "total": None, "block": b"HTTP/1.1 200 OK\r\n\r\nab" if not k else b"cd", "declared": None} for k in (0, 1, 2)]
    rows[-1]["total"] = 25

    def result(rows):
        return next(iter(run(warc._batches(iter(rows))))).to_pylist()[0]

    assert result(rows)["payload_bytes"] == 6
    assert "missing" in result([rows[0], rows[2]])["problem"] and result(rows[:2])["problem"] == "no total length"
    assert "total length" in result([rows[0], rows[1], rows[2] | {"total": 24}])["problem"]


def text_of(page):
    return html_text.main_text(html_text.slots(page, html_text.merge([html_text.expression(page)])))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><header>Site</header><nav>menu<main><h1>T &amp; x</h1><p class="ad">buy<p>real <b>bo</b>ld<br>next &lt;tag&gt;<aside>side</aside><p>two<form>f<input></form><div class="comments"><p>hey</p></div></main><footer>f', "T & x\nreal bold next <tag>\ntwo"),
        ('<div id="cookie-notice">c</div><div class="post-content"><p>a</p> <ul><li>x<li>y</ul><script>var a="<p>no</p>"</script><blockquote>q</blockquote></div><p>out', "a\nx\ny\nq"),
        ("plain a < b <i>x</i>", "plain a < b x"),
        ("<article><p>one<article class='comment'><p>c</article><p>two</article>", "one\ntwo"),
        ("<title>t</title><style>p{}</style><!-- c --><article>  a \n\t b </article>", "a b"),
        (None, ""),
        ("", ""),
        ("<article></article>", ""),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_wrappers_hold_all_their_pages():
    rng = random.Random(2)
    streams = []
    for _ in range(60):
        s = ["a"] + ["p", "#"] * rng.randrange(4) + (["x", "#", "/x"] if rng.random() < 0.5 else []) + ["li"] * rng.randrange(5) + (["y"] if rng.random() < 0.3 else []) + ["/a"]
        streams.append(s)
    wrapper = html_text.merge([dumps(fold(s)) for s in streams])
    for s in streams:
        places = Wrapper(json.loads(wrapper)).match(s)
        assert places is not None and len(places) == len(s)
    assert fold(["p", "#"] * 5 + ["q"]) == [["+", ["p", "#"]], "q"]
    assert Wrapper(align(["a", "b"], ["a", "c"])).match(["a"]) is not None and Wrapper(["a"]).match(["b"]) is None


def test_template_slots_of_undecided_pages(spark):
    rows = [(k, "http://h.example/x", f"<div><p>Home</p><h2>{t}</h2><p>{t} text</p></div>") for k, t in enumerate("abcd")] + [(9, None, None), (None, "http://h.example/y", "<div><p>Home</p><h2>e</h2><p>e text</p></div>")]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages(spark, rows)).collect()}
    assert out[0] == "a\na text" and out[None] == "e\ne text" and out[9] == ""
    assert html_text.extract_main_text(pages(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [2, 3, 1000])
def test_copies_of_a_page_keep_their_text(spark, copies):
    page = "<div><p>Head</p><p>one story</p><h2>end</h2></div>"
    rows = [(k, "http://copies.example/x", page) for k in range(copies)] + [(-1 - k, None, page) for k in range(copies)]
    rows += [(5000 + k, "http://mixed.example/x", f"<div><p>Home</p><h2>{t}</h2></div>") for k, t in enumerate("abc")] + [(6000 + k, "http://mixed.example/y", "<div><p>Home</p><h2>d</h2><ol><li>own</li></ol></div>") for k in range(copies)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages(spark, rows)).collect()}
    assert {out[k] for k in range(-copies, copies)} == {"Head\none story\nend"}
    assert [out[5000 + k] for k in range(3)] == ["a", "b", "c"] and {out[6000 + k] for k in range(copies)} == {"d\nown"}


def test_wrappers_decide_inside_landmarks(spark):
    story = "a long story of {0} that goes on for quite a while and says {0} again"
    rows = [(k, "http://frame.example/x", f"<article><h1>{t}</h1><div>Follow us</div><p>{story.format(t)}</p></article>") for k, t in enumerate("abc")]
    rows += [(10 + k, "http://teaser.example/x", f"<main><h1>{t}</h1><p>{story.format(t)}</p><article>more {t}</article></main>") for k, t in enumerate("abc")]
    rows += [(20 + k, "http://near.example/x", f"<article><h1>same</h1><div>{story.format('it')}</div><p>read {k}</p></article>") for k in range(4)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages(spark, rows)).collect()}
    assert [out[k] for k in range(3)] == [f"{t}\n{story.format(t)}" for t in "abc"]
    assert all(story.format(t) in out[10 + k] for k, t in enumerate("abc"))
    assert [out[20 + k] for k in range(4)] == [f"same\n{story.format('it')}\nread {k}" for k in range(4)]


def test_tokens_know_their_surroundings():
    assert [x for x in tokens("<nav><ul><li>m</ul></nav><p>t") if x[0][0] == "#"] == [("#b", ""), ("#u", "t")]


def plain_main_text(pages):
    """Main texts by an aligner of its own kind: slots are told by the tags around a text, for pages of one shape."""
    out = {}
    for host in {p[1] for p in pages}:
        own = [p for p in pages if p[1] == host]
        slots = {k: {p[2][k] for p in own} for k in range(len(own[0][2]))}
        for i, _, parts in own:
            out[i] = "\n".join(t for k, t in enumerate(parts) if len(slots[k]) > 1)
    return out


def test_main_text_equals_a_plain_version(spark):
    """Pages without landmarks: of every host the slots that vary are text, whatever stands where."""
    rng = random.Random(9)
    plain, rows = [], []
    for h in range(12):
        tags = [f"{rng.choice(['div', 'section', 'td'])} class=x{chr(97 + k)}" for k in range(rng.randrange(3, 9))]
        fixed = {k: f"frame {h} {k}" for k in range(len(tags)) if rng.random() < 0.5}
        for n in range(rng.randrange(4, 9)):
            texts = [fixed.get(k, f"story {h} {n} {k}") for k in range(len(tags))]
            i = 100 * h + n
            plain.append((i, h, texts))
            rows.append((i, f"http://h{h}.example/{n}", "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in zip(tags, texts, strict=True))))
    rows += rows[:5]
    out = [(r["page_id"], r["text"]) for r in html_text.extract_main_text(pages(spark, rows)).collect()]
    want = plain_main_text(plain)
    assert len(out) == len(rows) and [(i, t) for i, t in out if want[i] != t] == []
    whole = {i: "\n".join(x) for i, _, x in plain}
    assert sum(want[i] != whole[i] for i in want) > 30  # without wrappers, the frames would stay


def test_long_and_broken_pages(spark):
    """Pages of more than a megabyte, and such as are only open or stray tags, end in a bounded time."""
    story = "".join(f"<h2>part {k}</h2><p>sentence {k} of it</p>" for k in range(30_000))
    other = "".join(f"<p>line {k}</p><div class=q>{k}</div>" for k in range(20_000))
    rows = [(1, "http://l.example/1", f"<article>{story}</article>"), (2, "http://l.example/2", f"<article>{other}</article>"), (3, "http://l.example/3", "<div>" * 20_000 + "a" + "</span></p>" * 20_000)]
    rows += [(4, "http://l.example/4", '<a "' * 20_000), (5, "http://l.example/5", "<li><div>" * 10_000 + "end"), (1, "http://l.example/1", f"<article>{story}</article>")]
    out = [(r["page_id"], r["text"]) for r in html_text.extract_main_text(pages(spark, rows)).collect()]
    found = dict(out)
    assert len(out) == 6 and len([x for x in out if x[0] == 1]) == 2
    assert found[1].split("\n")[:3] == ["part 0", "sentence 0 of it", "part 1"] and found[1].count("\n") == 59_999 and found[2].count("\n") == 39_999
    assert found[3] == "a" and found[5] == "end"


def test_alignment_of_long_sequences(monkeypatch):
    """What lies between anchors is aligned as short sequences are, and the wrapper holds both sides."""
    rng = random.Random(10)
    for _ in range(300):
        x, y = ([rng.choice("abcdefghijklm") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        monkeypatch.setattr(wrappers, "CELLS", rng.choice([0, 4, 50]))
        found = Wrapper(align(fold(x), fold(y)))
        assert found.match(x) is not None and found.match(y) is not None
    monkeypatch.setattr(wrappers, "CELLS", 0)
    assert align([*"axb"], [*"ayb"]) == ["a", ["?", ["x"]], ["?", ["y"]], "b"]
    assert align([*"xqay"], [*"zaqw"]) in ([["?", ["x"]], ["?", ["z", "a"]], "q", ["?", ["a", "y"]], ["?", ["w"]]], [["?", ["x", "q"]], ["?", ["z"]], "a", ["?", ["y"]], ["?", ["q", "w"]]])


@pytest.mark.parametrize(("part", "fan"), [(1, 2), (3, 32)])
def test_wrappers_of_many_parts(spark, monkeypatch, part, fan):
    monkeypatch.setattr(html_text, "PART", part)
    monkeypatch.setattr(html_text, "FAN", fan)
    rows = [(k, "http://many.example/x", f"<div><p>Home</p>{'<h2>a</h2>' * (k % 5)}{'<ol><li>b</ol>' * (k % 7 > 3)}<p>{k} text</p></div>") for k in range(40)]
    made = html_text.infer_wrappers(spark.createDataFrame([("many.example", r[2]) for r in rows], "host string, html string")).collect()
    assert len(made) == 1 and all(Wrapper(json.loads(made[0]["wrapper"])).match([s for s, _ in tokens(h)]) is not None for _, _, h in rows)
