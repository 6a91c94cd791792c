import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

from ledgerline.llm import quality, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_archives_come_back_whole(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://b", None), (4, "http://c\r\nX: y", ""), (None, "n", "null id"), (9, "u", "é" * 100000), (9, "u", "é" * 100000), (10, "u", "WARC/1.1\r\n\r\n"), (11, "v", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.archive_pages(df, f"file://{tmp_path}/w").collect()
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    first = {h: max((x for x in ids if x is not None), default=None) for h, ids in groups.items()}
    expected = []
    for i, _, html in rows:
        raw, top = (html or "").encode(), first[html or ""]
        again = len(groups[html or ""]) > 1 and i != top
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)


def test_predicates_are_put_to_the_headers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    records = spark.createDataFrame([(f"<urn:{i}>", "response" if i % 2 else "metadata", f"http://h{i % 3}/", "2024", bytes([65 + i]) * 5) for i in range(9)], "record_id string, record_type string, target_uri string, date string, payload binary")
    warc.write_warc(records, path)
    df = warc.read_warc(spark, path, ["record_id", "payload"] + ["record_type", "target_uri"]).filter("record_type = 'response' and target_uri like 'http://h1%'")
    assert "PythonFilter" in df._jdf.queryExecution().toString() or df.count() == 2
    assert sorted((r.record_id, bytes(r.payload)) for r in df.collect()) == [("<urn:1>", b"BBBBB"), ("<urn:7>", b"HHHHH")]
    assert warc.read_warc(spark, path).count() == 9
    warc.write_warc(records.limit(0), f"file://{tmp_path}/none")
    reader = warc.WarcReader(warc.read_warc(spark, path).schema, path)
    from pyspark.sql.datasource import EqualTo, IsNull

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), IsNull(("date",))])) == [IsNull(("date",))]
    assert not reader.wanted({"warc-type": "metadata"}) and reader.wanted({"warc-type": "response"})


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def corpus():
    random.seed(9)
    sentence = lambda n: " ".join(random.choice(["al", "bé", "gam", "del", "x1", "#y"]) + str(random.randrange(90)) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [sentence(random.randint(1, 12)) for _ in range(random.randint(1, 5))]
        if i % 2:
            lines.insert(0, "Subscribe to our newsletter, now 7!" if i % 4 == 1 else "subscribe to OUR newsletter now 3")
        if i % 7 == 0:
            lines += lines[:2]
        rows.append((i, "\n".join(lines), ["h1", "h2", None][i % 3]))
    rows += [(100 + i, "boiler plate of this host\nboiler plate of this host\nown words " + str(i), "h1") for i in range(15)]
    rows += [(200 + i, sentence(5) * 3 + "\n" + "the same copy of a long text that many have", "h4") for i in range(1)] * 30
    return rows + [(1, None, "h1"), (None, "", None), (2, "a b c d e a b c d e a b c d e", "h2"), (3, "one two\v#three\x85four", "h2"), (4, "w " * 20000, "h2")]


def test_counts_and_verdicts(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = quality.assessed(df, least_docs=4, doc_share=0.2).collect()
    norm = lambda x: re.sub("[!-/:-@\\[-`{-~\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    texts, docs = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                docs[s, norm(x)].add(t)
    expected = []
    for i, t, s in rows:
        n = plain_counts(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and len(docs[s, norm(x)]) > max(4, 0.2 * len(texts[s])))
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        expected.append((i, *n, failed, not failed and gone <= 0.5 * n[0], gone))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(expected, key=repr)
    out = quality.cleaned(df, least_docs=4, doc_share=0.2)
    assert out.columns == df.columns and out.count() == sum(e[7] for e in expected)
    assert not any("boiler plate" in r.text or "newsletter" in r.text for r in out.filter("source in ('h1', 'h2')").collect())
    assert quality.assessed(df.limit(0)).collect() == []


def test_cleaned_with_names_of_its_own(spark):
    rows = [(i, "words of this text are many enough to stay here " + str(i), "h1", "x", 1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __of string, __kept int, ___hash int")
    assert sorted(tuple(r) for r in quality.cleaned(df).collect()) == rows
