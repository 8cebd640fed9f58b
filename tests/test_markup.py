"""Plain text of documents with markup of their own, against a reader letter by letter."""

import html

from __spark_entry__ import queries

TEXTS = [
    "<html><HEAD><style>p > a {}</style><script>if (a < b) x();</SCRIPT ></head><body><p>Annual&nbsp;report</p></body></html>",
    "> quoted line\n> another &amp; more", "a < b and c > d", "1 <2 >0", "AT&T &lt;b&gt; &amp;lt; &#8217;&#x2014;&mdash;&sect; &bogus;", "<!-- a > b <p> -->kept<br/>", "<a title=\"x>y\" href='u>v'>link</a>",
    "x\x0by", "<p don't>it's</p>", "<t " + "a=1 " * 2000 + ">wide</t>", "", None, "plain", "<unclosed", "a &lt;", "<?xml version='1.0'?><!DOCTYPE html><td=>z",
]


def plain(t):
    if t is None:
        return None
    out, i, low = [], 0, t.lower()
    while i < len(t):
        kind = next((k for k in ("script", "style") if low.startswith("<" + k, i) and not low[i + len(k) + 1 : i + len(k) + 2].isalnum()), None)
        if kind and (end := low.find("</" + kind, i)) >= 0:
            i = low.index(">", end) + 1
            out.append(" ")
        elif t.startswith("<!--", i) and (end := t.find("-->", i)) >= 0:
            i = end + 3
            out.append(" ")
        elif t[i] == "<" and (t[i + 1 : i + 2].isalpha() or t[i + 1 : i + 2] in ("/", "!", "?")) and t.find(">", i) >= 0:
            quote, j = "", i
            while quote or t[j] != ">":
                if quote:
                    quote = "" if t[j] == quote else quote
                elif t[j] in "'\"" and t[j - 1] == "=":
                    quote = t[j]
                j += 1
            i = j + 1
            out.append(" ")
        elif t[i] == "&" and ";" in t[i:] and t[i + 1 : t.index(";", i)].lstrip("#").isalnum():
            end = t.index(";", i) + 1
            out.append(html.unescape(t[i:end]))
            i = end
        else:
            out.append(t[i])
            i += 1
    return " ".join("".join(out).split())


def test_every_document_comes_out(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.plain for r in queries()["html_to_text_all"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
