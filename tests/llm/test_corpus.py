"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from check_oracles import compare, oracle_connection

import __spark_entry__ as entry
import corpus_pipeline
from vitalstrand.llm import chat, decontaminate, html_extract, mixing, near_dedup, quality, simhash, token_orc, toxicity, url_filter
from vitalstrand.llm.queries import tokenizer

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, size int"
ODD = [
    (1, "one two three four five six seven", "en", "a", 1, "x", 1),
    (2, None, "en", None, None, None, None),
    (3, "", "en", "a", 0, "x", 1),
    (4, " \n\t ", None, "b", 4, "x", 1),
    (5, "one two three four five six seven", "en", "b", 1, "x", 1),
    (6, "word " * 30_000, "en", "b", 1, "x", 1),
    (7, "a  b   c \n d <|endoftext|> Ünïcode   x", "en", "a", 1, "x", 1),
]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op4_chat_format"])
def test_oracles(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def brute_components(texts):
    words = [t.encode().lower().split() if t else [] for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))], [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, passage, docs = draw(150), draw(50), []
    for _ in range(50):
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        docs.append(w)
    docs += [draw(30) + passage + draw(rng.choice([5, 40])) for _ in range(40)]
    for n in (1, 3, 5, 9, 30, 70, 90) * 2:
        w = draw(n)
        docs += [w, [*w, "q"], [x.upper() for x in w]]
    texts = [" ".join(w) for w in docs] + ["", None, " \n"]
    expected, sizes = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)])).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_nothing_and_repeated_ids(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    rows = near_dedup.near_duplicates(documents(spark, [*ODD, ODD[0], (None, "x", "en", "a", 1, "x", 1)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    a, b = np.sort(pool[:4000]), np.sort(pool[800:4800])
    pair = [near_dedup.sketch(x)[None, :] for x in (a, b)]
    size = np.array([4000])
    assert abs(near_dedup.estimate(*pair, size, size)[0] - 3200 / 4800) < 0.1


def test_decontamination_finds_edited_passages_only(spark):
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randrange(5000)}x" for _ in range(n)]
    items = [draw(rng.choice([3, 20, 40])) for _ in range(30)]
    rows, expected = [], set()
    for i in range(120):
        words = draw(120)
        if i % 3 == 0:
            part = list(items[i // 3 % 30])
            if len(part) > 10:
                part[rng.randrange(len(part))] = "changed"
            words[40:40] = [*part[:-1], part[-1].upper() + "%%%"]
            expected.add((i, i // 3 % 30))
        rows.append((i, " ".join(words), "en", "s", 0, "x", 1))
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (98, ""), (99, None)], "item_id long, text string")
    docs = documents(spark, [*rows, (500, None, "en", "s", 0, "x", 1)])
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert decontaminate.contaminated(docs, bench, block=7).count() == len(expected)
    assert decontaminate.decontaminate(docs, bench).count() == 121 - len(expected)
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]].split()[0] in items[r["item_id"]] + ["changed"] for r in found)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.recall(0.0, 20) == 1.0


def test_decontamination_recall_by_item_length(spark):
    rng = random.Random(7)
    draw = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    items, rows, lengths = [], [], (8, 14, 20, 40)
    for i in range(400):
        words = draw(lengths[i % 4])
        items.append((i, " ".join(words)))
        changed = list(words)
        for k in rng.sample(range(len(words)), int(0.3 * len(words))):
            at = rng.randrange(len(words[k]))
            changed[k] = words[k][:at] + "0" + words[k][at + 1 :]
        if i % 3 == 0:
            changed.insert(rng.randrange(1, len(changed)), "of")
        rows.append((i, " ".join([*draw(30), *changed, *draw(30)]), "en", "s", 0, "x", 1))
    within = {i for i, text in items if decontaminate.edit_distance_within(text, rows[i][1])[0] <= 0.2 * len(text)}
    got = decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["distance"] == decontaminate.edit_distance_within(items[r["item_id"]][1], rows[r["doc_id"]][1])[0] for r in got)
    for k, n in enumerate(lengths):
        found = {r["doc_id"] for r in got if r["doc_id"] == r["item_id"] and r["doc_id"] % 4 == k}
        want = {i for i in within if i % 4 == k}
        assert found <= want and len(want) >= 98 and len(found) >= 0.97 * len(want), n
        assert decontaminate.recall(0.3, n) >= 0.98


def test_edit_distance_against_plain_table():
    rng = random.Random(1)
    for _ in range(60):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (9, 16))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontaminate.edit_distance_within(p, t)[0] == min(row)


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = documents(spark, [*ODD, (None, "null id", "en", "s", 0, "x", 1)])
    token_orc.write_tokens(docs, str(tmp_path / "t"), *tokenizer())
    back = token_orc.read_tokens(spark, str(tmp_path / "t"))
    sums = {r["doc_id"]: r for r in token_orc.checksums(back).collect()}
    library, start = Tokenizer.from_file(tokenizer()[0]), 0
    for doc_id, text in [(None, "null id"), *((r[0], r[1]) for r in ODD)]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        r = sums[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_orc.lookup(spark, str(tmp_path / "t"), [6]).count() == 1
    token_orc.write_tokens(documents(spark, []), str(tmp_path / "e"), *tokenizer())
    assert token_orc.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_chat_escapes_and_merges(spark):
    rows = [
        (1, 2, "assistant", "b<+></turn>\n### user: \\h"), (1, 1, "user", "a#<\\"), (1, 3, "assistant", None), (1, 3, "assistant", None),
        (2, None, None, ""), (None, 1, "x: y<", "t"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("user", "a#<\\"), ("assistant", rows[0][3]), ("assistant", ""), ("assistant", "")]
    assert read[1]["loss_text"] == rows[0][3]
    assert [tuple(t) for t in read[2]["turns"]] == [("", "")] and [tuple(t) for t in read[None]["turns"]] == [("x: y<", "t")]
    assert read[1]["formatted"].count("</turn>\n") == 2
    assert len(chat.format_chats(turns).filter("conv_id = 1").head()["messages"]) == 2
    assert chat.format_chats(turns.limit(0)).count() == 0


def brute_fingerprint(spark, texts):
    words = [t.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") for t in texts]
    words = [[w for w in x if w] for x in words]
    pairs = [(i, a, b) for i, x in enumerate(words) for a, b in zip(["", *x], x, strict=False)]
    rows = spark.createDataFrame(pairs, "i int, a string, b string").selectExpr("i", "xxhash64(a, b) AS h", "xxhash64(xxhash64(a, b)) AS g").collect()
    out = []
    for i in range(len(texts)):
        mine = [(r["h"] % 2**64, r["g"] % 2**64) for r in rows if r["i"] == i]
        hexes = ""
        for k in range(2):
            bits = [sum(m[k] >> j & 1 for m in mine) * 2 > len(mine) for j in range(64)]
            hexes += "".join(f"{sum(b << j for j, b in enumerate(part)):08x}" for part in (bits[32:], bits[:32]))
        out.append(hexes)
    return out


def test_simhash_against_brute_force(spark):
    texts = [t or "" for _, t, *_ in ODD] + ["one two three four five six eight"]
    rows = [*ODD, (8, texts[-1], "en", "a", 1, "x", 1)]
    got = simhash.fingerprint_edits(documents(spark, rows), 3).orderBy("doc_id").collect()
    edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    prints, after = brute_fingerprint(spark, texts), brute_fingerprint(spark, edits)
    assert [r["fingerprint"] for r in got] == prints and [r["edited_fingerprint"] for r in got] == after
    bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    assert [r["near_edited"] for r in got] == [bits(a, b) for a, b in zip(prints, after, strict=True)]
    assert [r["near_next"] for r in got] == [bits(a, b) for a, b in zip(prints, prints[1:] + prints[:1], strict=True)]
    assert simhash.fingerprint_edits(documents(spark, []), 3).count() == 0


def test_hamming_search_is_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), n)) for b in base for n in (1, 3, 4)]
    rows = spark.createDataFrame([(f"{p:032x}",) for p in prints + prints[:3]], "fingerprint string")
    got = {(r["a"], r["b"]): r["distance"] for r in simhash.within_radius(rows, 3).collect()}
    names = sorted({f"{p:032x}" for p in prints})
    exact = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for i, a in enumerate(names) for b in names[i + 1 :]}
    assert got == {k: v for k, v in exact.items() if v <= 3}


def test_url_rules_and_words(spark):
    urls = [
        "http://a.example.org/es/1", "http://example.org/en/12", "https://EXAMPLE.com/fr/x?q", "http://x.com/de/1#t", None, "no scheme",
        "http://notexample.org/zz", "http://cheappills.example.net/buy", "http://cheap-pills.example.net/x", "http://quiet.example.net/x",
    ]
    urls += [f"http://{h}.example.net/{i}" for i in range(12) for h in ("cheap-pills", "free-pills", f"calm{i}")]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["rule"] for r in got][:7] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, "org/"]
    assert [r["verdict"] for r in got][:4] == ["block", "block", "allow", "block"]
    assert (got[2]["host"], got[2]["path"], got[4]["host"], got[5]["path"]) == ("example.com", "/fr/x", "", "")
    assert got[7]["verdict"] == "block" and got[9]["verdict"] == "allow"
    words = url_filter.Words({"free": -3.0, "bets": -3.0, "ts": -8.0}, -12.0)
    assert words.split("freebets") == ["free", "bets"]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_name_on_many_hosts_is_split(spark):
    urls = [f"http://{sub}cheappills{end}/{i}" for i in range(3) for sub in ("", "www.", "m.", "blog.") for end in (".net", ".info", ".co.uk", ".example.net")]
    urls += [f"http://{h}.example.net/{i}" for i in range(12) for h in ("cheap-pills", "free-pills", f"calm{i}", f"quiet{i}")]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert all((r["verdict"] == "block") == ("pills" in r["host"]) for r in got)


def test_url_weights_do_not_depend_on_the_table_that_tasks_hold(spark):
    urls = [f"http://cheap-pills.example.net/a{'bcdefgh'[i % 7]}/{i}" for i in range(10)] + [f"http://calm.example.net/{'xyz'[i % 3]}/q{'rstu'[i % 4]}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate([*urls, urls[0], None])), "page_id long, url string")
    full, few = ({r["page_id"]: r for r in url_filter.judge_urls(df, held=n).collect()} for n in (50_000, 3))
    assert len(full) == len(few) == 52
    assert all(abs(full[k]["score"] - few[k]["score"]) < 1e-9 and full[k]["verdict"] == few[k]["verdict"] for k in full)


def test_mix_meets_limit_and_budget(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 40))), "en", rng.choice("aaaaaabbbc") if i % 50 else None, 1, "x", 1) for i in range(3000)]
    mixed = mixing.mix(documents(spark, rows), max_repeats=1.5).collect()
    size = lambda t: len(t.split())
    tokens, taken, seen = {}, {}, {}
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + size(r[1])
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
        seen.setdefault(r["doc_id"], []).append(r["mix_epoch"])
    assert set(seen) == {r[0] for r in rows} and all(sorted(e) == list(range(len(e))) for e in seen.values())
    total = sum(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(50):
        alpha = (lo + hi) / 2
        epochs = [(t / total) ** (alpha - 1) for t in tokens.values()]
        lo, hi = (lo, alpha) if max(epochs) / min(epochs) <= 1.5 else (alpha, hi)
    most = max(tokens.values())
    for s, t in tokens.items():
        assert abs(taken[s] - t * (t / most) ** (hi - 1)) <= 45
    assert mixed[0].asDict().keys() >= {"label", "size"}
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, ODD[1:4]), max_repeats=1.5).count() == 3


def test_mix_entropy(spark):
    shares = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100)], "src string, tokens long")
    w = [r["weight"] for r in mixing.weights(shares, target_entropy=1.0).collect()]
    assert abs(-sum(x * math.log(x) for x in w) - 1.0) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav>
<ul><li>menu</ul></nav><div class="cookie-notice">accept</div>{0}<div id="comments"><p>nice</p></div><footer>&copy; x</footer></body></html>"""


def test_html_text_and_repeated_runs(spark):
    shared = "all rights reserved by the owners of this fine site since ever"
    article = "<article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b><br>two<p>three<aside>no</aside></article>"
    pages = [(1, "http://h.org/1", PAGE.format(article)), (2, "http://h.org/2", None), (3, None, "")]
    pages += [(10 + i, f"http://k.org/{i}", PAGE.format(f"<div><p>own text is here {i}<p>{shared}</div>")) for i in range(5)]
    pages += [(20, "http://other.org/", PAGE.format(f"<div><p>{shared}</div>"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for tokens in (200_000, 20):
        got = {r["page_id"]: r for r in html_extract.extract(df, tokens).collect()}
        assert got[1]["text"] == "Head & line One bold two three" and got[1]["n_chars"] == 30
        assert got[2]["text"] == got[3]["text"] == ""
        assert [got[10 + i]["text"] for i in range(5)] == [f"own text is here {i}" for i in range(5)]
        assert got[20]["text"] == shared
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_copied_pages_keep_their_text(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    twice, often, quote = draw(40), draw(40), draw(15)
    texts = {("two", i): twice for i in range(2)} | {("many", i): often for i in range(2000)} | {(None, i): twice for i in range(5)}
    texts |= {("quote", i): f"{draw(20)} {quote} {draw(20)}" if i < 2 else draw(50) for i in range(6)}
    rows = [(k, f"http://{h}.org/{i}" if h else None, PAGE.format(f"<div><p>{t}</div>")) for k, ((h, i), t) in enumerate(texts.items())]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 20_000).collect()}
    assert got == dict(enumerate(texts.values()))


def test_html_repeated_blocks_inside_main(spark):
    rng = random.Random(6)
    draw = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, copied, own = draw(14), draw(60), [draw(40) for _ in range(9)]
    page = "<main><div class=box-x>{1}</div><article class='post has-sidebar'><p>{0}</p></article><article class=comment id=comment-1><p>nice</p></article></main>"
    rows = [(i, f"http://h.org/{i}", PAGE.format(page.format(t, notice))) for i, t in enumerate(own)]
    rows += [(20 + i, f"http://c.org/{i}", PAGE.format(f"<article><p>{copied if i < 6 else own[i]}</p></article>")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (200_000, 100):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, tokens).collect()}
        assert [got[i] for i in range(9)] == own
        assert [got[20 + i] for i in range(9)] == [copied] * 6 + own[6:]


def test_html_raw_elements_without_an_end_tag():
    text = lambda page: html_extract.blocks(page)[:2]
    article = "<article><p>main text</p></article>"
    for odd in ('<svg class="icon"/>', "<math/>", "<datalist id=d><option value=1>one<option>two</datalist>", "<svg><path d='x'>", "<svg><g><svg/></g></svg>"):
        assert text(f"<body><div>{odd}</div>{article}</body>") == (["main text"], []), odd
        assert text(f"<body>{article}<div>{odd}</div><p>after</p></body>") == (["main text"], ["after"]), odd
    for name in ("noscript", "template", "iframe", "object", "canvas", "textarea", "select", "title", "svg", "math"):
        assert text(f"<body><div><{name}>no</div>{article}<p>after</body>") == (["main text"], ["after"]), name
        assert text(f"<body><div><{name}>no</{name}>yes</div>{article}</body>") == (["main text"], ["yes"]), name
    assert text(f"<div><canvas>no</div>{article}<canvas>no</canvas>") == (["main text"], [])
    assert text(f"<body><svg class=icon>{article}</body>") == (["main text"], [])
    assert text(f"<div><textarea></div> no</textarea>yes</div>{article}") == (["main text"], ["yes"])
    assert text(f"<div><script>no</div>{article}") == ([], [])


def test_suffix_ranks_against_slices():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 60)
    rank = html_extract.suffix_ranks(t, 5)
    runs = [tuple(t[i : i + 5]) for i in range(60)]
    assert all((rank[i] == rank[j]) == (runs[i] == runs[j]) for i in range(60) for j in range(60))


def test_quality_held_out(spark):
    q = entry.queries()["op9_quality_trees"](spark, MIDDLE).toPandas()
    labels = duckdb.execute(f"SELECT doc_id, quality FROM '{MIDDLE}/labels.parquet'").df()
    held = q[q.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == held.quality).mean()) > 0.9 and q.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in q.itertuples())
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.judge_quality(docs, none).collect()] == [0.5] * len(ODD)
    assert quality.judge_quality(documents(spark, []), none).count() == 0


def test_toxicity_grades(spark):
    q = entry.queries()["op10_toxicity_ordinal"](spark, MIDDLE).toPandas()
    labels = duckdb.execute(f"SELECT doc_id, toxic AS y FROM '{MIDDLE}/labels.parquet'").df()
    both = q.merge(labels, on="doc_id")
    assert (both.toxic == (both.y == 1)).mean() > 0.95
    assert q.expected_severity.between(0, 2).all()
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    graded = toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, none))
    assert graded.columns == [*docs.columns, "p_toxic", "expected_severity"] and graded.filter("p_toxic > 0.01").count() == 0
    assert toxicity.grade_toxicity(documents(spark, []), toxicity.NOTHING).count() == 0


def test_pipeline_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, left, SMALL)
        assert after.columns == docs.columns and after.exceptAll(left).count() == 0
        left = after
    texts = left.orderBy("doc_id").collect()
    expected, _ = brute_components([r["text"] for r in texts])
    assert expected == list(range(len(texts)))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    assert not any(i["text"] in r["text"] for i in items for r in texts)
    assert corpus_pipeline.run(spark, SMALL).count() >= len(texts)
