"""Each operator against a brute-force version, on random and on odd input."""

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobtide.llm import (
    chat_repair, decontaminate, line_crf, packing, quality_rules, queries, sharding, simhash_dedup, token_counts, toxicity, url_filter,
)
from tests_support import DOCS, slow_components, slow_fingerprint, slow_passages

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, equal texts, a clashing column."""
    rng = random.Random(1)
    long_ = prose(rng, 9000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long_, "en", "a", len(long_)),
        (5, "One line only.", None, "b", 1), (5, "One line only.", None, "b", 1), (6, "One line only.", "en", "a", 1),
        (None, "a text without id", "en", None, 3), (None, None, None, None, None), (None, "a text without id", "en", None, 3),
        (7, "É" * 30 + " 　 x\x1cy", "fr", "b", 5), (8, "same line here\n" * 40, "en", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in (
        "score", "size", "fp", "words", "row", "tag", "shard", "n_words", "kept", "bin", "k", "y", "rule", "host")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 0, 1), (8, 0, 1), (None, 1, 1), (6, None, None)],
                                 "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 1 toxicity

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, past = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(past[j] + 1, row[-1] + 1, past[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(3)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 11))) for _ in range(40)]
    automaton = toxicity.Automaton(terms, most_states=300)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        word = "".join(word)
        near = [(edit_distance(word, t), t) for t in set(terms)]
        near = [(k, t) for k, t in near if k <= toxicity.edits_allowed(len(t))]
        assert automaton.match(word) == (min(near)[::-1] if near else None)


def test_toxicity_learns_terms_spelling_and_quotation(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        text, toxic = prose(rng, 40).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["blockhead", "nitwit", "dunderpate"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs.join(lab, "doc_id").select("text", F.col("toxic").alias("y")))
    assert set(lexicon.terms) == {"blockhead", "nitwit", "dunderpate"}
    asked = ["you are a blockhed today", "calm words", "he was told “nitwit” by them once", None, "", "nitwit", "dunderpate! blockhead nitwit"]
    found = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, t string").orderBy("i").select(
        toxicity.score(F.col("t"), lexicon).alias("s")).collect()]
    assert [s >= 0.3 for s in found] == [True, False, False, False, False, True, True]
    out = {r.doc_id: r for r in toxicity.judge_toxicity(docs, lab).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert all(out[i].predicted == t for i, _, t in marks)


def test_stray_marks_are_no_quotation():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    find = lambda word: 0.95 if word == "nitwit" else 0.0
    judged = lambda text: toxicity.score_text(text, {}, find)
    assert judged("nitwit") == judged(f'a 5" pipe {words(500)} nitwit {words(500)} a 7" pipe') == pytest.approx(0.95)
    assert judged(f'a 5" pipe {words(500)} "you nitwit" {words(500)}') == pytest.approx(0.95 * toxicity.QUOTED)
    assert judged(f'"{words(10)} nitwit" then') == pytest.approx(0.95 * toxicity.QUOTED)
    assert toxicity.quoted_places(['"', "a", '"', "b", '"', "c"]) == [False, True, False, False, False, False]


def test_toxicity_odd(odd, labels, spark):
    out = rows_of(toxicity.judge_toxicity(odd, labels))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.judge_toxicity(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in rows_of(toxicity.judge_toxicity(odd, labels.limit(0)))} == {0.0}


# 2 URL filter

def test_url_filter_carries_trust_and_distrust(spark):
    link = '<a class=x HREF="{}">'
    pages = [
        (1, "http://good.example.com/a", link.format("//Friend.org/x") + link.format("/own")),
        (2, "HTTP://friend.org", link.format("https://good.example.com/")), (3, "http://x.net/fr/1", ""), (4, "http://x.net/fr/2", None),
        (5, "http://lurer.org/p?u=http://q", link.format("http://x.net/en") * 3), (6, "http://x.net/en/", "<p>"), (7, None, "x"),
        (8, "no scheme", ""), (9, "http://www.example.com/en/a#b?c", ""), (9, "http://www.example.com/en/a#b?c", ""),
        (10, "http://m.example.com/en/", ""), (11, "http://example.com", ""), (None, "https://alone.org/?q", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = rows_of(url_filter.judge_urls(df, ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(pages)
    assert got[1] == ("good.example.com", "/a", "com/", "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[2] == ("friend.org", "", None, "allow") and got[5] == ("lurer.org", "/p", None, "block")
    assert got[6][3] == "block" and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][1:] == ("/en/a", "www.example.com/en/", "allow") and got[10][2:] == ("example.com/en/", "block")
    assert got[11] == ("example.com", "", None, "allow") and got[None] == ("alone.org", "/", None, "allow")
    assert url_filter.judge_urls(df.limit(0), ["com/"], ["net/fr/"]).count() == 0


def test_propagation_is_power_iteration(spark):
    rng = np.random.default_rng(2)
    links = [(f"h{a}", f"h{b}", int(rng.integers(1, 5))) for a in range(12) for b in rng.choice(12, 3, replace=False) if a != b]
    seed = {f"h{i}": float(rng.random()) for i in range(12)}
    m = np.zeros((12, 12))
    for a, b, n in links:
        m[int(b[1:]), int(a[1:])] += n
    m = m / np.maximum(1, m.sum(axis=0))
    want = np.linalg.solve(np.eye(12) - 0.85 * m, np.array([seed[f"h{i}"] for i in range(12)]))
    got = url_filter.propagate(spark.createDataFrame(list(seed.items()), "host string, seed double"),
                               spark.createDataFrame(links, "src string, dst string, n long"), 0.85).collect()
    assert len(got) == 12 and all(math.isclose(r.score, want[int(r.host[1:])], abs_tol=1e-7) for r in got)


def as_sql(said, **tables):
    """Rows of a SQL twin on tables given as ``(columns, rows)``."""
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"create table {name} ({columns})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(said)
    return [dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()]


def test_url_filter_agrees_with_sql_on_linked_hosts(spark):
    """Among them a host with a blocked share of 0.15 that is linked both ways with another: its verdict needs the limit."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(i, "http://slow.net/fr/1" if i < 3 else "http://slow.net/en/1", link("pal.org")) for i in range(20)]
    pages += [(100 + i, "http://pal.org/", link("slow.net")) for i in range(4)]
    rng = random.Random(12)
    hosts = ["a.com", "b.org", "c.net", "www.example.com", "example.com", "d.net", "e.io"]
    for i in range(80):
        h = rng.choice(hosts)
        pages.append((200 + i, f"http://{h}/{rng.choice(['en/', 'es/', 'fr/', ''])}", link(*rng.sample(hosts, 2))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = rows_of(url_filter.judge_urls(df, queries.ALLOW, queries.BLOCK))
    want = as_sql(queries.SQL["op2_url_filter"], pages=("page_id bigint, url varchar, html varchar", pages))
    shown = lambda rows: sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"], round(r["trust"], 5), round(r["distrust"], 5)) for r in rows)
    assert shown(out) == shown(want)
    assert {r["verdict"] for r in out if r["host"] == "slow.net"} == {"block"}


def test_equally_long_rules(spark):
    df = spark.createDataFrame([(1, "http://x.a.com/x/y", "")], "page_id long, url string, html string")
    assert rows_of(url_filter.judge_urls(df, ["a.com/"], ["com/x/"]))[0]["rule"] == "a.com/"


# 3 quality rules

def slow_counts(text):
    words = (text or "").encode().split()
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab ", "cd ", "ef\n", "g\x0b", "#", "é "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    joined = quality_rules.judge_rules(docs.select("text", F.monotonically_increasing_id().alias("doc_id")).persist(), rows=50)
    want = Counter(slow_counts(r.text) for r in docs.collect())
    assert Counter(tuple(r[c] for c in quality_rules.COUNTS) for r in joined.collect()) == want
    for r in joined.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge_rules(odd.limit(0)).count() == 0


def test_cascade_orders_by_rejection_per_cost_and_keeps_the_verdict(spark, odd):
    rules = [quality_rules.Rule(n, None) for n in "abc"]
    flags = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert [r.name for r in quality_rules.cascade(rules, np.array([9.0, 1.0, 2.0]), flags)] == ["b", "c", "a"]
    kept = quality_rules.apply_rules(odd)
    want = [r.doc_id for r in odd.collect() if not any(rule.rejects(quality_rules.Measures(r.text)) for rule in quality_rules.RULES)]
    assert [r.doc_id for r in kept.collect()] == want and kept.columns == odd.columns


# 4 decontamination

def test_passages_match_brute_force(spark, odd):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([3, 14, 25, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, None)]
    items.append((77, items[4][1]))
    docs = []
    for d in range(120):
        text = prose(rng, rng.randrange(0, 120)).split()
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 3])):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randrange(2)] = ["changed"] * rng.randrange(3)
            at = rng.randrange(len(text) + 1)
            text[at:at] = ["\n", *(w.title() for w in passage), "!!"]
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.find_passages(df, bench).collect()}
    want = {k: round(s, 6) for k, (s, _) in slow_passages(docs, items[:25]).items()}
    assert got == want and len(want) > 30
    kept = decontaminate.without_passages(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want}) and kept.columns == df.columns
    assert decontaminate.find_passages(odd, bench.limit(0)).count() == 0
    assert decontaminate.find_passages(odd.limit(0), bench).count() == 0
    leak = odd.unionByName(spark.createDataFrame([(None, items[3][1])], "doc_id long, text string"), allowMissingColumns=True)
    assert decontaminate.without_passages(leak, bench).count() == odd.count()


def test_passages_with_swapped_halves(spark):
    rng = random.Random(31)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 46, 60, 60, 90])]
    docs = []
    for i, passage in items:
        w = passage.split()
        swapped = [*w[len(w) // 2 :], *w[: len(w) // 2]]
        docs.append((2 * i, " ".join([prose(rng, 100), *swapped, prose(rng, 100)])))
        docs.append((2 * i + 1, " ".join([*swapped, *swapped])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.find_passages(df, bench).collect()}
    want = {k: round(s, 6) for k, (s, _) in slow_passages(docs, items).items()}
    assert got == want and {(4, 2), (6, 3), (8, 4)} <= want.keys()
    said = as_sql(queries.SQL["op4_benchmark_decontamination"], documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", items))
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in said} == got


def test_hamming_blocks_and_simhash(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a - (1 << 64) * (a >> 63), rng.sample(range(64), rng.randrange(23))))
    flip = lambda a, bits: (lambda u: u - (1 << 64) * (u >> 63))((a ^ sum(1 << b for b in bits)) & (2**64 - 1))
    df = spark.createDataFrame([(a, flip(a, b)) for a, b in pairs], "a long, b long")
    met = df.select(F.arrays_overlap(decontaminate.blocks_of(F.col("a"), 22), decontaminate.blocks_of(F.col("b"), 22)).alias("met"))
    assert all(r.met for r in met.collect())
    words = ["a", "b", "c", "a"]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    got = spark.createDataFrame([(words,)], "w array<string>").select(decontaminate.simhash(F.col("w")).alias("f")).first().f
    assert got & (2**64 - 1) == want


# 5 sharding

@pytest.mark.parametrize("copies", [1, 3])
def test_shards(spark, odd, copies):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(500)] * copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = rows_of(sharding.byte_shards(docs, 8))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    lowest = -1
    for s in range(8):
        part = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= largest
        for r in part:
            assert (r["doc_id"] if r["doc_id"] is not None else -1) >= lowest
            lowest = r["doc_id"] if r["doc_id"] is not None else -1
    assert sharding.byte_shards(odd.limit(0)).count() == 0


# 6 chat repair

def slow_repair(roles):
    """Least cost over all ways to repair a short conversation."""
    best = None
    for choice in itertools.product([0, 1, 2, 3], repeat=len(roles)):  # 0 merges
        state, cost = 0, 0
        for role, new in zip(roles, choice):
            after = new or state
            if not after or (new and (state, new) not in chat_repair.GAP):
                break
            cost += 0 if role == after else chat_repair.RELABEL if role else chat_repair.UNKNOWN
            cost += chat_repair.INSERT * len(chat_repair.GAP[state, new]) if new else chat_repair.MERGE
            state = after
        else:
            cost += chat_repair.INSERT * len(chat_repair.FINISH[state])
            best = cost if best is None else min(best, cost)
    return best


def test_repair_is_cheapest_and_legal():
    rng = random.Random(10)
    for _ in range(400):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        steps = chat_repair.repair(roles)
        made, cost = [], 0
        for (new, action, gap), was in zip(steps, roles):
            made += gap + ([] if action == "merge" else [new])
            cost += chat_repair.INSERT * len(gap) + chat_repair.MERGE * (action == "merge") + (0 if was == new else chat_repair.RELABEL if was else chat_repair.UNKNOWN)
        made += chat_repair.FINISH[made[-1]]
        cost += chat_repair.INSERT * len(chat_repair.FINISH[steps[-1][0]])
        body = made[1:] if made[0] == 1 else made
        assert body == [2, 3] * (len(body) // 2) and body and cost == slow_repair(roles)


def test_blocks_give_the_same_cost(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "System ", None, "bot"]), rng.choice(["x", "", None, "long " * 50]))
            for c, n in [(1, 300), (2, 3), (3, 1), (None, 40), (4, 17)] for t in range(n)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("clash"))
    costs = {}
    for block in (7, 4096):
        out = rows_of(chat_repair.format_chats(df, block=block))
        assert len(out) == len(rows)
        for conv in (1, 2, 3, None, 4):
            turns = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["at"])
            assert [r["at"] for r in turns] == list(range(len(turns)))
            text = "".join(r["rendered"] for r in turns)
            made = [p.split("|>")[0] for p in text.split("<|")[1:]]
            body = made[1:] if made[0] == "system" else made
            assert body == ["user", "assistant"] * (len(body) // 2) and body
            costs.setdefault(conv, set()).add(sum(r["cost"] for r in turns))
    assert all(len(c) == 1 for c in costs.values())
    assert chat_repair.format_chats(df.limit(0)).count() == 0


# 7 token counts

def vocabulary():
    found = pytest.importorskip("public_tokenizers")
    return found.path("byte_bpe_50k.json")


def test_token_counts_match_the_library(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    alphabet = ["a", "The", " ", "  ", "\n", "'s", "'", "é", "12", "½", "²", " ", "　", "\x1c", "\x85", " ", "😀", "中", "!", "<|endoftext|>", "\t", "ǅ", "́", "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(c) + rng.choice([" ", "x", "  "]) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3100, 500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    tokenizer = Tokenizer.from_file(str(vocabulary()))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    for common in (200_000, 40):  # with few common pre-tokens most go through the shuffled join
        monkeypatch.setattr(token_counts, "COMMON", common)
        out = token_counts.count_tokens(docs, str(vocabulary())).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert token_counts.count_tokens(odd.limit(0), str(vocabulary())).count() == 0


# 8 line classifier

def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 7, 8])
    node, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = line_crf.forward_backward(node, edge, first)
    want, counts = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        ways = list(itertools.product([0, 1], repeat=b - a))
        weight = [math.exp(sum(node[a + i] * s for i, s in enumerate(w)) + sum(edge[x, y] for x, y in zip(w, w[1:]))) for w in ways]
        for w, p in zip(ways, np.array(weight) / sum(weight)):
            want[a:b] += p * np.array(w, float)
            for x, y in zip(w, w[1:]):
                counts[x, y] += p
    assert np.allclose(good, want) and np.allclose(pairs, counts)


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(13)
    texts = [None, "", "\n\n", "A b b\n\nA b b\nX!!! $$", prose(rng, 50), "É é.\n \n"]
    whole = line_crf.line_features(texts)
    for i, t in enumerate(texts):
        one = line_crf.line_features([t])
        assert np.array_equal(one.features, whole.features[whole.first[i] : whole.first[i + 1]])
    assert np.diff(whole.first).tolist() == [0, 0, 0, 3, 1, 1]


def test_classifier_holds_out_and_separates(spark, odd, labels):
    rng = random.Random(14)
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        lines = [prose(rng, 12) + "." for _ in range(6)]
        if bad:
            lines[1:] = [x.upper() + "!!" if i % 8 else " | ".join(x.split()) + " $$$" for x in lines[1:]]
        rows.append((i, "\n".join(lines), "en", "s", 0))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in line_crf.judge_quality(docs, lab).collect()}
    assert all(out[i].predicted == q for i, q, _ in marks)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    found = rows_of(line_crf.judge_quality(odd, lab))
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert line_crf.judge_quality(odd.limit(0), lab).count() == 0
    assert {r["score"] for r in rows_of(line_crf.judge_quality(odd, lab.limit(0)))} == {0.0, 0.5}
    assert line_crf.keep_good(odd, lab).columns == odd.columns


# 9 near-duplicates

def test_golay_code_is_perfect_and_keys_meet():
    tables = simhash_dedup.syndromes()
    assert len(set(tables[1].tolist())) == 2048
    rng = random.Random(15)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(3)))
        keys = [set(simhash_dedup.fuzzy_keys(np.array([x], np.uint64), tables)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1] and all(len(k) <= 18 for k in keys)


@pytest.mark.parametrize("bucket,distance", [(256, 2), (1, 2), (1, 1), (256, 0)])
def test_links_match_brute_force(spark, bucket, distance):
    rng = random.Random(16)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    for _ in range(250):
        fps.append(rng.choice(fps) ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))))
    signed = lambda f: f - (1 << 64) * (f >> 63)
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.link_edges(df, distance, bucket)).collect()}
    want = slow_components(set(fps), distance)
    groups = lambda of: sorted(sorted(f for f in set(fps) if of(f) == k) for k in {of(f) for f in set(fps)})
    assert groups(lambda f: roots.get(signed(f), signed(f))) == groups(want.get)


def test_near_duplicates_and_the_kept_row(spark, odd):
    rng = random.Random(17)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts += [t + " Alpha1" for t in texts[:20]] + texts[:10] + [t.upper() for t in texts[:5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(
        odd.select("doc_id", "text").where("doc_id is null or doc_id > 0").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    root = slow_components(set(fps))
    low = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            low[root[f]] = min(low.get(root[f], 10**9), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", low.get(root[f])) for r, f in zip(rows, fps))
    assert Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()) == want
    kept = simhash_dedup.keep_one(docs.withColumn("fp", F.lit("clash"))).collect()
    assert sorted(root[slow_fingerprint(r.text)] for r in kept) == sorted(set(root.values()))
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0 and simhash_dedup.keep_one(odd.limit(0)).count() == 0


# 10 packing

def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and not (s is not None and s in b["s"]) and not (c is not None and c in b["c"])]
        if fits:
            at = min(fits)[1]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            at = len(bins) - 1
        bins[at]["room"] -= size
        bins[at]["s"].add(s)
        bins[at]["c"].add(c)
        out.append(at)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(18)
    for _ in range(60):
        n = rng.randrange(0, 80)
        sizes = sorted((rng.randrange(0, 50) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot", "hot", None, *"abcdefgh"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(30)]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 60) == slow_best_fit(sizes, sources, clusters, 60)


def test_packing_keeps_all_words_and_conflicts(spark, odd):
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.choice([3, 50, 200, 900])), "en", rng.choice("aaabcd"), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    out = rows_of(packing.pack(docs, capacity=400, group_rows=64))
    assert sum(r["n_words"] for r in out) == sum(len((r.text or "").encode().split()) for r in docs.collect())
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(r.doc_id for r in docs.collect())
    for _, part in itertools.groupby(sorted(out, key=lambda r: r["bin"]), key=lambda r: r["bin"]):
        part = list(part)
        named = [r["source"] for r in part if r["source"] is not None]
        assert sum(r["n_words"] for r in part) <= 400 and len(named) == len(set(named))
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert packing.pack(odd.limit(0)).count() == 0


def test_bins_do_not_depend_on_partitions(spark):
    rng = random.Random(29)
    rows = [(i, prose(rng, rng.choice([3, 50, 200])), "en", rng.choice("aaab"), 0) for i in range(120)]
    rows += rows[:10] + [(None, "same text", "en", "c", 0)] * 5 + [rows[3]] * 3
    docs = spark.createDataFrame(rows, DOCS)
    bins = []
    for parts in (1, 3, 7):
        out = rows_of(packing.pack(docs.repartition(parts), capacity=300, group_rows=40))
        assert len(out) == len(rows) and len({(r["bin"], r["slot"]) for r in out}) == len(out)
        bins.append(sorted(sorted((r["doc_id"] or -1, r["source"], r["n_words"]) for r in part)
                           for _, part in itertools.groupby(sorted(out, key=lambda r: r["bin"]), key=lambda r: r["bin"])))
    assert bins[0] == bins[1] == bins[2]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rng = random.Random(23)
    rows = []
    for i in range(40):
        w = prose(rng, 300).split()
        for j in range(4):
            w = [*w[:-1], f"last{j}"] if j else w
            rows.append((4 * i + j, " ".join(w), "en", f"s{j}", 0))
    rows += [(None, rows[0][1], "en", "other", 0), (1, rows[9][1] + " x", "en", "more", 0), (990, "", "en", "p", 0), (991, None, "en", "q", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    fps = {r[1]: slow_fingerprint(r[1]) for r in rows if r[1]}
    root = slow_components(set(fps.values()))
    by_source = {(r[0], r[3]): root[fps[r[1]]] for r in rows if r[1]}
    assert len(set(by_source.values())) < len(set(fps.values()))  # near copies that are no exact copies
    out = rows_of(queries.op10_best_fit_packing(spark, str(tmp_path)))
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r[0], r[3]) for r in rows)
    for _, part in itertools.groupby(sorted(out, key=lambda r: r["bin"]), key=lambda r: r["bin"]):
        held = [by_source[r["doc_id"], r["source"]] for r in part if (r["doc_id"], r["source"]) in by_source]
        assert len(held) == len(set(held))
