"""Chat formatting, URL judgements, licenses and benchmark leaks."""

import json
import random
import re
from collections import defaultdict

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from tagplane.llm import chat, decontamination, licenses, urls

from .conftest import SF, lower, words


def test_chat_equals_oracle(spark):
    rows = chat.op4_fingerprinted_chat(spark, SF)
    columns = sorted(rows.columns)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = db.execute(chat.OP4_ORACLE)
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in rows.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


LAYOUTS = [
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"response": "c", "prompt": "p"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": None}, "question", [("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("system", "i"), ("user", "x"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"rows": [{"turn": 1, "role": "assistant", "text": "b"}, {"turn": 0, "role": "user", "text": "a"}]}, "turn_rows", [("user", "a"), ("assistant", "b")]),
    ({"who": "knows"}, None, None),
]


def test_layouts(spark):
    data = [(i, json.dumps(x[0])) for i, x in enumerate(LAYOUTS)] + [(98, "not json"), (99, None)]
    got = {r["conv_id"]: (r["layout"], r["turns"]) for r in chat.canonical(spark.createDataFrame(data, "conv_id long, payload string")).collect()}
    for i, (_, name, turns) in enumerate(LAYOUTS):
        assert got[i][0] == name
        assert (None if got[i][1] is None else [tuple(t) for t in got[i][1]]) == turns
    assert got[98] == (None, None) and got[99] == (None, None)


NASTY = st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "</s>", "<s>", "INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "|im_end|>", "\n", "<<SYS>>", "é", "ok ", "&lt;", "%0A"]), max_size=12).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool call\n", "", "<|im_end|>"]), NASTY), min_size=1, max_size=4), min_size=1, max_size=8))
def test_round_trip(spark, conversations):
    table = spark.createDataFrame([(i, [list(t) for t in c]) for i, c in enumerate(conversations)], "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat.formatted(table).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        want = conversations[r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want) and not re.search(r"</s>|\[/?INST\]", r["formatted"])


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "a"), (None, 0, "assistant", "x" * 100_000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rows string")
    out = chat.formatted(chat.canonical(chat.conversation_records(table)))
    got = {r["conv_id"]: r["turns"] for r in out.collect()}
    assert [tuple(t) for t in got[1]] == [("", ""), ("user", "a"), ("user", "b"), ("user", "b")]
    assert len(got[None][0]["text"]) == 100_000
    assert chat.formatted(chat.canonical(chat.conversation_records(table.limit(0)))).count() == 0


# --- urls ---------------------------------------------------------------------------------------


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.rule), default=None)


def brute_rank(edges, restart):
    """Settled ranks of a graph whose walks start with these masses."""
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(restart)
    for _ in range(200):
        new = defaultdict(float, restart)
        for (a, b), w in edges.items():
            new[b] += rank.get(a, 0.0) * w / out[a] * urls.DAMPING
        rank = new
    return rank


def brute_shares(edges, trust, bad):
    nodes = {x for e in edges for x in e} | set(trust) | set(bad)
    back = {(b, a): w for (a, b), w in edges.items()}
    plain = [brute_rank(e, dict.fromkeys(nodes, 1.0)) for e in (edges, back)]
    found = brute_rank(edges, trust), brute_rank(back, bad)
    return {h: tuple(found[k].get(h, 0.0) / plain[k][h] for k in (0, 1)) for h in nodes}


def brute_judge(pages, block_list=()):
    hosts, edges = defaultdict(list), defaultdict(float)
    for _, url, html in pages:
        host, path = parse(url)
        r = rule_of(host, path)
        if host:
            hosts[host].append(r.verdict if r else None)
        for dst in {m for m in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html or "")}:
            edges[host, lower(dst)] += 1
    known = {x for e in edges for x in e if x} | set(hosts)
    for h in {".".join(x.split(".")[k:]) for x in known for k in range(max(len(x.split(".")) - 2, 1))}:
        labels = h.split(".")
        if len(labels) > 2:
            p = ".".join(labels[1:])
            edges[h, p] += 1
            edges[p, h] += 1
    edges = {(a, b): w for (a, b), w in edges.items() if a and b and a != b}
    listed = {h for h in hosts if set(h.split(".")) & set(block_list)}
    trust = {h: v.count("allow") / len(v) for h, v in hosts.items() if v.count("allow") and h not in listed}
    bad = {h: 1.0 if h in listed else v.count("block") / len(v) for h, v in hosts.items() if v.count("block") or h in listed}
    shares = brute_shares(edges, trust, bad)
    out = {}
    for i, url, _ in pages:
        host, path = parse(url)
        r = rule_of(host, path)
        t, d = shares.get(host, (0.0, 0.0))
        # Near ties may fall either way, by the order of sums.
        verdict = r.verdict if r else ("block" if host and d - urls.RATIO * t > urls.MARGIN else "allow")
        out[i] = (host, path, r.rule if r else None, verdict, abs(d - urls.RATIO * t - urls.MARGIN) < 1e-8)
    return out


PAGES = [
    (1, None, None), (2, "no scheme", "x"), (3, "http://A.Example.ORG/en/12?q=1", '<a href="https://spam-farm.example.net/x">'), (4, "x://b.example.com", None),
    (5, "http://b.example.com/de/1#/x", "<a HREF='//Good.example.org/'>"), (6, "http://c.net?x/y://z", ""), (7, "http://spam-farm.example.net/a", '<a href="http://c.net/">'),
    (7, "http://spam-farm.example.net/a", '<a href="http://c.net/">'), (8, "http://good.example.org/es/1", "<a href=/rel>"), (9, "http://notexample.org/es/", ""), (10, "http://example.org/en/1x", ""),
    (11, "http:///path", ""), (12, "http://x.com/fr/" + "a" * 50_000, "z" * 200_000),
]


def test_urls(spark):
    table = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    want = brute_judge(PAGES)
    rows = urls.judge(table).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        host, path, rule, verdict, tie = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert tie or r["verdict"] == verdict
    assert urls.judge(table.limit(0)).count() == 0
    listed = brute_judge(PAGES, ("spam-farm",))
    assert {(r["page_id"], r["verdict"]) for r in urls.judge(table, blocked_labels=("spam-farm",)).collect()} == {(i, w[3]) for i, w in listed.items()}
    assert listed[7][3] == "block"


@pytest.mark.parametrize("kind", ["hub", "star"])
def test_shares_are_settled_ranks(spark, monkeypatch, kind):
    """A portal with many links in pieces and a chain, and ties that go to and fro."""
    edges = {
        "hub": {("hub", f"h{i}"): 1.0 + i % 3 for i in range(1, 100)} | {("h0", "hub"): 1.0, ("h1", "h3"): 2.0, ("h3", "h5"): 1.0},
        "star": {e: 1.0 for i in range(30) for e in (("hub", f"h{i}"), (f"h{i}", "hub"))},
    }[kind]
    trust, bad = {"h0": 1.0, "h1": 0.25}, {"h5": 1.0, "h7": 0.5, "alone": 1.0}
    monkeypatch.setattr(urls, "LINKS_PER_PIECE", 7)
    want = brute_shares(edges, trust, bad)
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), bad.get(h, 0.0)) for h in {**trust, **bad}], "host string, trust double, distrust double")
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.rank_shares(table, seeds, hosts, margin=None, tolerance=1e-4).collect()}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h], abs=1e-4) for h in want)
    soon = {r["host"]: r["distrust"] - r["trust"] > 0.01 for r in urls.rank_shares(table, seeds, hosts).collect()}
    assert all(soon[h] == (d - t > 0.01) for h, (t, d) in want.items())


def test_all_parents_are_tied(spark):
    pages = spark.createDataFrame([("a.b.c.example.org", "")], "host string, html string")
    ties = {(r["src"], r["dst"]) for r in urls.host_edges(pages).collect()}
    chain = ["a.b.c.example.org", "b.c.example.org", "c.example.org", "example.org"]
    assert ties == {p for a, b in zip(chain, chain[1:]) for p in ((a, b), (b, a))}


def test_url_query(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = brute_judge(pages)
    for r in urls.op5_link_trust(spark, SF).collect():
        host, path, rule, verdict, tie = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert tie or r["verdict"] == verdict


# --- licenses -----------------------------------------------------------------------------------


def test_alignment_is_rising_and_covers():
    rng = random.Random(2)
    for _ in range(200):
        template = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 15))]
        text = list(template)
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randrange(len(text) + 1), rng.choice("abcxyz"))
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.align("x a b c y d".split(), "a b c d".split())) == 4
    assert [v for v in (3, 1, 2, 5, 4)][licenses.rising([3, 1, 2, 5, 4])[0]] == 1


def test_licenses(spark):
    mit = licenses.NOTICES["MIT"][1]
    changed = mit.replace("obtaining a copy", "who gets one copy").replace("software", "code", 1)
    filler = "of the and to under this license any as is " * 60
    rows = [
        (1, filler + "\nReleased under the MIT License.\n" + filler), (2, changed), (3, filler), (4, "Licensed under the Apache License, Version 2.0. " * 3),
        (5, "released some code under another license from MIT"), (6, None), (7, ""), (8, "w " * 300_000 + "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."),
        (None, "This work is licensed under the GNU General Public License, version 3."), (9, mit[: len(mit) // 3]),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (4, "Apache-2.0"), (8, "CC-BY-NC-4.0"), (8, "CC-BY-NC-4.0"), (None, "GPL-3.0")], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_that_are_much_alike(spark):
    """Each notice gives its own name and no other, in other spacing and letter case and with an edited word too; licenses that are not known give none."""
    rows, want = [], set()
    for name, notices in licenses.NOTICES.items():
        for text in notices:
            for form in (text, "Some code.\n" + "\n * ".join(text.upper().split()) + "\nand more words after it", text.replace("permission", "consent")):
                rows.append((len(rows), form))
                want.add((len(rows) - 1, name))
    near = licenses.NOTICES
    for text in (
        near["GPL-2.0"][0].replace("version 2", "version 9"), near["Apache-2.0"][0].replace("2.0", "3.7"), near["CC-BY-4.0"][1].replace("Attribution", "Attribution NonCommercial"),
        near["CC-BY-4.0"][0].replace("4.0", "2.5"), near["GPL-3.0"][1].replace("General", "Library General"), near["MPL-2.0"][0].replace("2.0", "1.1"),
    ):
        rows.append((len(rows), text))
    rows.append((len(rows), near["BSD-2-Clause"][0] + ": one. two. " + near["BSD-3-Clause"][0]))
    want.add((len(rows) - 1, "BSD-3-Clause"))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_scan_equals_aligning_whole_texts(spark, small_texts):
    """Stretches around rare words find what aligning each whole text with each template finds."""
    plain = {i: [licenses.plain(w) for w in words(t)] for i, t in small_texts.items()}
    want = set()
    for i, text in plain.items():
        for t in licenses.TEMPLATES:
            if len(set(text) & set(t.seeds)) < t.least_seeds:
                continue
            for k in range(0, max(len(text) - len(t.words), 0) + 1):
                part = text[k : k + 2 * len(t.words)]
                if part and part[0] == t.words[0]:
                    pairs = licenses.align(part, t.words)
                    n, first, last = licenses.best_run(pairs, len(t.words))
                    if n >= licenses.COVERAGE * len(t.words) and t.told(part, pairs, first, last):
                        want.add((i, t.license))
    got = {(r["doc_id"], r["license"]) for r in licenses.op6_patience(spark, SF).collect()}
    assert got == want and len(got) >= 3


def test_license_query(spark, small_texts):
    marks = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License", "GPL-3.0": "GNU General Public License", "CC-BY-NC-4.0": "CC BY-NC"}
    want = {(i, k) for i, t in small_texts.items() for k, m in marks.items() if m in t}
    assert {(r["doc_id"], r["license"]) for r in licenses.op6_patience(spark, SF).collect()} == want


# --- benchmark leaks ----------------------------------------------------------------------------


def test_leaks_query(spark, small_texts):
    flat = lambda t: " ".join(words(lower(t)))
    items = {r["item_id"]: flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in small_texts.items() for i, x in items.items() if x in flat(t)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.op8_template_windows(spark, SF).collect()} == want


def test_reparameterised_questions(spark):
    question = "a train leaves the station with 30 passengers and at the next stop 12 leave while 30 others join, so how many are with Alice now on it"
    items = [(1, question), (2, None), (3, ""), (4, "short one here"), (5, question.replace("Alice", "Bob").replace("train", "tram"))]
    same = question.replace("30", "55").replace("12", "7").replace("Alice", "Carol")
    inconsistent = question.replace("with 30", "with 55").replace("while 30", "while 31").replace("12", "7")
    docs = [
        (1, "some text before it. " + question), (2, "before. " + same + " and after"), (3, "before. " + inconsistent), (4, None), (5, ""), (6, "it is a short one here you see"),
        (7, "a short one is not here"), (8, "short one here"), (8, "short one here"), (None, question), (9, "x " * 200_000 + same),
    ]
    table = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, pos string, window string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.leaks(table, bench).collect()}
    assert got.pop((1, 1)) is True and got.pop((2, 1)) is False and got.pop((9, 1)) is False
    assert (3, 1) not in got
    assert not any(k[1] in (2, 3) for k in got)
    assert {k for k in got if k[1] == 4} == {(6, 4), (8, 4)}
    assert decontamination.leaks(table.limit(0), bench).count() == 0
    assert decontamination.leaks(table, bench.limit(0)).count() == 0


def brute_leaks(docs, items):
    """Pairs that leak by chains of windows of plain lower-case words alone, and pairs with nothing in common.

    A chain is grown window by window: the best of all that end in a window, over all windows before it.
    """
    bare = lambda t: [w.strip("""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""") or w for w in words(lower(t))]
    leak, apart = set(), set()
    for i, t in items:
        own = bare(t)
        width = min(len(own), max(4, min(8, len(own) // 3)))
        for d, text in docs:
            theirs = bare(text)
            places = {}
            for p in range(len(theirs) - width + 1):
                places.setdefault(tuple(theirs[p : p + width]), []).append(p)
            hits = sorted((p, q) for q in range(len(own) - width + 1 if own else 0) for p in places.get(tuple(own[q : q + width]), []))
            if hits and (len(own) >= 4 or len(own) >= 0.25 * len(theirs)):
                best = []
                for p, q in hits:
                    before = [b for (p2, q2), b in zip(hits, best, strict=False) if p2 < p and q2 < q and p - p2 - width <= 8 and q - q2 - width <= 8]
                    best.append(max((b for b in before), key=len, default=frozenset()) | frozenset(range(q, q + width)))
                if max(map(len, best)) >= 0.5 * len(own):
                    leak.add((d, i))
            if not hits and not any(c.isdigit() for c in t):
                apart.add((d, i))
    return leak, apart


def test_chains_rise_and_keep_one_mapping(spark):
    """Pieces in swapped order are no copy, an inserted word breaks nothing, slots must agree over the whole chain."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha beta gamma delta end".split()
    far = [f"w{k}" for k in range(60)]
    number = "in the first year the farm had 30 cows and all were healthy and strong while in the second year it again had 30 cows in the barn"
    twice = number.replace("30", "55", 1)
    docs = [
        (1, " ".join(item[12:20] + far + item[:8])), (2, " ".join([*item[:12], "really", *item[12:]])), (3, " ".join(item[:10] + far + item[10:20])), (4, " ".join(item[:9] + item[14:])),
        (5, number.replace("30", "55").replace("while in", "while also in")), (6, twice.replace("30", "31").replace("while in", "while also in")), (7, number.replace("while in", "while also in")),
        (8, "Yes, but " + " ".join(far)), (9, "Yes!"), (10, "Well, yes of course"),
    ]
    items = [(1, " ".join(item)), (2, number), (3, "Yes")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(2, 1), (4, 1), (5, 2), (7, 2), (9, 3), (10, 3)}
    assert got[2, 1]["coverage"] == 1.0 and got[2, 1]["first_word"] == 0 and got[5, 2]["exact"] is False and got[7, 2]["exact"] is True


def test_edits_names_and_letter_case(spark):
    """Opening names, other letter case and one edited word leave a question found; items may share an id."""
    short = "Ann has 3 apples and eats two today"
    plain = "every river that runs down from these hills ends in one wide and very quiet lake"
    names = "Alice met Robert and Clara before Daniel and Emily saw Frank near Geneva with Henry and Irene"
    items = [(1, short), (2, plain), (3, names), (4, plain.replace("river", "stream") + " at last"), (4, "something else that nobody will ever write in this way again")]
    docs = [
        (1, "Bob has 7 apples and eats two today"), (2, "He said it. Carol has 9 apples and eats two today. Yes"), (3, plain.upper()), (4, plain.title()), (5, names.lower()),
        (6, plain.replace("ends", "stops")), (7, plain.replace("down", "away")), (8, "nothing of all that is in this text, which has only words of its own and no more"), (9, "Something else that nobody will ever write in this way again!"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 2), (7, 2), (9, 4)} <= got
    assert not [k for k in got if k[0] == 8]


def test_plain_copies_against_all_pairs(spark, small_texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak, apart = brute_leaks(list(small_texts.items()), items)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op8_template_windows(spark, SF).collect()}
    assert leak <= got
    assert not got & apart
