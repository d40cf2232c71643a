"""Preference pairs and page text."""
import duckdb
import pytest

from tapeloom.llm import preferences, queries, style_tree
from . import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    from scripts.compare import canonical
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{brute.SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, brute.SF)
    cur = con.execute(queries.SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())


def test_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, None, [u, b]), (4, None, None), (5, [u], [u, b]), (6, [(None, None), a], [(None, None), b]),
            (1, [u, a], [u, b])]
    df = spark.createDataFrame([(*r, "k") for r in rows], f"k bigint, chosen {turn}, rejected {turn}, prompt string")
    made = preferences.format_pairs(df, "k").collect()
    got = {r["k"]: r for r in made}
    assert len(made) == 7 and len(got) == 6
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["prompt_turns"] == 1
    assert one["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n" and one["rejected"] == "<|im_start|>assistant\nno<|im_end|>\n"
    trained = [c for m, t in ((one["chosen_mask"], one["chosen"]),) for c in [t[m[0]["n"]:m[0]["n"] + m[1]["n"]]]]
    assert trained == ["yes<|im_end|>\n"] and [m["trained"] for m in one["chosen_mask"]] == [False, True]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prompt_turns"] == 2 and got[2]["chosen_mask"] == []
    assert got[3]["prompt"] == "" and got[3]["chosen"] == "" and got[4]["rejected"] == ""
    assert got[5]["chosen"] == "" and got[5]["rejected"] != "" and got[6]["prompt_turns"] == 1
    assert "Python" not in preferences.format_pairs(df, "k")._jdf.queryExecution().toString()


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"),
            (2, 0, "user", "alone"), (2, 1, "assistant", "a2"), (4, 0, "user", "no reply"), (5, 0, "user", None), (5, 1, "assistant", "a5"),
            (None, 0, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, pair string, at int")
    got = {r["conv_id"]: (r["chosen"], r["rejected"]) for r in preferences.with_swapped_reply(df).collect()}
    texts = {k: tuple([t["text"] for t in side] for side in v) for k, v in got.items()}
    assert texts == {0: (["q0", "a0"], ["q0", "a1"]), 1: (["q1", "a1"], ["q1", "a0"]), 2: (["alone", "a2"], ["alone"]),
                     4: (["no reply"], ["no reply"]), 5: ([None, "a5"], [None]), None: ([None, "x"], [None, "x"])}
    assert preferences.with_swapped_reply(df.where("false")).count() == 0


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="nav-open"><header><h1>Site</h1></header>
<nav><a href=x>menu</a></nav><div id="cookie-notice">cookies</div><main><article class=post><h1>Tit&amp;le</h1><p><b>One<br>two&nbsp; x<p>Three
<i>it</i>alic. <!-- <p>no</p> --><script>var a = "</p><p>no";</script><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>
<form><p>send</form><div class="comments"><p>bad</p></div><p>End &lt;tag&gt;.</article></main><aside>side</aside><footer>f</footer></body></html>"""


def test_blocks_of_a_page():
    assert [b[1] for b in style_tree.blocks(PAGE)[0]] == ["Tit&le", "One two x", "Three italic.", "a", "b", "1", "2", "End <tag>."]
    for broken in ("", "<", "</p>", "<p", "a<b", "<div><p></div></div>x", "<script>", "<!--", "<td>x", "<a><a></a>", "&#xZZ;&bogus;"):
        style_tree.blocks(broken)


def test_host_tree_removes_what_repeats(spark):
    def page(i, extra=""):
        return (f"<body><div class='zq'><p>Call us now at the same number</p><p>Terms of the house</p></div><div class='qx'>"
                f"<a href=a>link {i}</a> <a href=b>other {i}</a></div><div class='t{i}'><p>Text {i} that no other page has.</p>"
                f"<p>And a second part {i}{extra}.</p></div></body>")

    rows = [(i, f"https://host.example/{i}", page(i)) for i in range(12)]
    rows += [(100, "https://host.example/3", page(3)), (101, "http://single.example/", page(50)), (102, None, page(51)), (103, "not a url", page(52)),
             (104, "https://host.example/x", None), (105, "https://host.example/y", ""), (105, "https://host.example/y", "")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id bigint, url string, html string, host string, node int")
    got = {}
    for r in style_tree.extract(df).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]] = r["text"]
    for i in range(12):
        assert got[i] == f"Text {i} that no other page has.\n\nAnd a second part {i}."
    assert got[100] == got[3] and got[104] == got[105] == ""
    for i, n in ((101, 50), (102, 51), (103, 52)):
        assert got[i].startswith("Call us now") and f"Text {n} that" in got[i]
    assert style_tree.extract(df.where("false")).count() == 0


def test_articles_stay_whole(spark):
    """Passages that articles share are no template."""
    import re
    from html import unescape
    pages = spark.read.parquet(f"{brute.SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    for p in pages.collect():
        art = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ")
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)>", art)]
        assert got[p["page_id"]] == "\n\n".join(w for w in want if w)
