"""op6 and op9: round trips."""

import hashlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import chat_grammar, warc_source
from panelcast.llm.common import shared_path

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", " ", "\\", "<", "[", "x", "\n", "é", "<\\s>", " [INST] ", "/s>"]
texts = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[INST] x", " [INST] "]) | texts, texts), min_size=1, max_size=5))
def test_format_reads_back(turns):
    s, spans = chat_grammar.format_turns(turns)
    assert [(r, t) for r, t, *_ in chat_grammar.parse(s)] == turns
    assert [chat_grammar.unescape(s[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(texts)
def test_escape_is_reversible(text):
    assert chat_grammar.unescape(chat_grammar.escape(text)) == text
    assert not any(c in chat_grammar.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]"))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (2, 3, "system", "</s>"), (None, 0, "user", "x"),
            (3, 0, "assistant", "[INST]" * 20_000), (4, 0, "user", "same"), (4, 0, "user", "same"), (1 << 60, 0, "user", "big id")]
    d = spark.createDataFrame([r + ("?",) for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_grammar.read_back(chat_grammar.format_conversations(d)).collect()}
    by = {}
    for i, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(i, []).append((r or "", x or ""))
    assert got.keys() == by.keys()
    for i, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns) and got[i].loss_chars == len(loss)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_grammar.read_back(chat_grammar.format_conversations(d.limit(0))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([r + ("?", "?") for r in rows], "page_id long, url string, html string, digest string, n string")


def brute(rows):
    p = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    p["b"] = [(h or "").encode() for h in p.html]
    first = p.groupby("b").page_id.transform("min")
    again = (p.b.str.len() >= 100) & first.notna() & ~(p.page_id == first).fillna(False)
    return sorted(str((None if pd.isna(i) else int(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if a else "response", int(f) if a else None))
                  for i, b, a, f in zip(p.page_id, p.b, again, first))


def test_warc_round_trip(spark):
    long = "<html>" + "é WARC/1.1\r\n\r\n" * 50
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "u", long), (3, "u", long), (1, "u", None), (2, "u", ""), (4, "u", "short"),
            (6, "u", "short"), (None, "u", long), (None, "u", "y" * 200), (7, "é", "z" * 99), (8, "u", "z" * 99), (10, "u", "q" * 300_000)]
    files = warc_source.write(pages(spark, rows))
    got = [str(tuple(r)) for r in warc_source.digests(spark, files._folder).collect()]
    assert sorted(got) == brute(rows)
    assert files.count() > 0 and files.selectExpr("sum(records)").first()[0] == len(rows)


def test_warc_whole_table(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    files = warc_source.write(p)
    got = [str(tuple(r)) for r in warc_source.digests(spark, files._folder).collect()]
    assert sorted(got) == brute([tuple(r) for r in p.select("page_id", "url", "html").collect()])


def test_warc_empty(spark):
    files = warc_source.write(pages(spark, []))
    assert warc_source.digests(spark, files._folder).count() == 0
    assert warc_source.load(spark, shared_path(spark, "nothing-here")).count() == 0


def test_warc_pushdown_skips_unwanted_payloads(spark, tmp_path):
    class Counting:
        def __init__(self, data):
            self.data, self.read = data, 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.read += n
            return self.data[at:at + n]

    body = b"x" * 100_000
    data = b"".join(warc_source.record("response", f"<urn:page:{i}>", f"http://h/{i}", "0", body, None) for i in range(20))
    f = Counting(data)
    rows = list(warc_source.records(f, lambda r: r["target_uri"] == "http://h/7"))
    assert len(rows) == 1 and rows[0][-1] == body and f.read < 200_000
    f = Counting(data)
    assert len(list(warc_source.records(f, lambda r: True, payload=False))) == 20 and f.read < 100_000

    (tmp_path / "a.warc").write_bytes(data)
    d = warc_source.load(spark, f"file://{tmp_path}").where("target_uri = 'http://h/7' and warc_type = 'response'")
    plan = d._jdf.queryExecution().explainString(d._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert d.count() == 1 and "target_uri" in plan
    assert warc_source.load(spark, f"file://{tmp_path}").where("record_id in ('<urn:page:1>', '<urn:page:2>') and http_length > 5").count() == 2
