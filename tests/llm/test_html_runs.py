"""op8 against brute force where runs decide, and its rules for names, quotes and deep pages."""

import random
import time

import pytest

from vitalstrand.llm import html_extract as he

SCHEMA = "page_id long, url string, html string"


def plain_extract(pages):
    """Text and covered tokens of (page_id, url, html) by counting every run of a host in every distinct text."""
    parsed = [(page, he.host_of(url), *he.blocks(html)) for page, url, html in pages]
    texts = {}
    for _, host, inside, loose, around, _ in parsed:
        if host:
            key = (host, (" ".join(inside), " ".join(loose)))
            words = " ".join(inside + loose + around).split()
            texts[key] = min(texts.get(key, words), words)
    runs_of = lambda words: {tuple(words[i : i + he.RUN]) for i in range(len(words) - he.RUN + 1)}
    held, number = {}, {}
    for (host, _), words in texts.items():
        number[host] = number.get(host, 0) + 1
        for run in runs_of(words):
            held[host, run] = held.get((host, run), 0) + 1
    out = {}
    for page, host, inside, loose, around, marked in parsed:
        words = " ".join(inside + loose + around).split()
        covered = [False] * len(words)
        for i in range(len(words) - he.RUN + 1):
            if held.get((host, tuple(words[i : i + he.RUN])), 0) >= max(he.LEAST, he.SHARE * number.get(host, 0)):
                covered[i : i + he.RUN] = [True] * he.RUN
        if marked:
            kept, at = [], 0
            for block in inside:
                n = len(block.split())
                if not all(covered[at : at + n]):
                    kept.append(block)
                at += n
            text = " ".join(kept or inside)
        else:
            own = " ".join(loose).split()
            text = " ".join(w for w, c in zip(own, covered) if not c) or " ".join(own)
        out[page] = (text, sum(covered))
    return out


def made_pages(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    notices = [say(rng.randint(9, 18)) for _ in range(4)]
    pages = []
    for page in range(n):
        host = f"h{page % 3}.org"
        body = [f"<p>{say(rng.randint(0, 30))}" for _ in range(rng.randint(0, 4))]
        body += [f"<p>{notice}" for k, notice in enumerate(notices) if rng.random() < (0.15, 0.24, 0.27, 0.8)[k]]
        rng.shuffle(body)
        inner = "".join(body)
        html = f"<main>{inner}</main>" if page % 2 else f"<div>{inner}</div>"
        pages.append((page, rng.choice([f"http://{host}/{page}"] * 9 + [None]), f"<body>{html}</body>"))
    # Copies of one page, null and empty pages, and a repeated row.
    pages += [(n + k, f"http://h0.org/c{k}", pages[0][2]) for k in range(40)]
    pages += [(n + 50, "http://h0.org/", None), (n + 51, "http://h1.org/", ""), pages[3]]
    return pages


@pytest.mark.parametrize("shard_tokens", [300, 200_000])
def test_runs_against_brute_force(spark, shard_tokens):
    pages = made_pages(7, 240)
    want = plain_extract(pages)
    got = he.extract(spark.createDataFrame(pages, SCHEMA), shard_tokens).collect()
    assert len(got) == len(pages)
    assert {r["page_id"]: (r["text"], r["n_repeated"]) for r in got} == want
    # Runs do decide here: texts were cut, on marked and on unmarked pages.
    whole = {p: " ".join(sum(he.blocks(h)[:2], [])) for p, _, h in pages}
    assert {p % 2 for p in want if p < 240 and want[p][0] != whole[p]} == {0, 1}


@pytest.mark.parametrize("part", ['p class="social-history"', 'section id="related-work"', 'p class="header-note"', 'p class="menu-engineering x"'])
def test_names_that_hold_a_listed_word_stay_inside_an_article(part):
    tag = part.split()[0]
    assert he.blocks(f"<article><p>a<{part}>b</{tag}><p>c</article>")[0] == ["a", "b", "c"]


@pytest.mark.parametrize("part", ['div class="share-buttons"', 'div id="ad-slot-2"', 'section class="comments"', 'div class="x related"', 'div id="comment-17"'])
def test_whole_names_go_inside_an_article(part):
    tag = part.split()[0]
    assert he.blocks(f"<article><p>a<{part}>b</{tag}><p>c</article>")[0] == ["a", "c"]


def test_unclosed_quotes_leave_no_markup():
    # As in browsers, `b<` is a name and its tag ends at the next `>`, so the paragraph goes on.
    assert he.blocks('<article><p>a<b</p><a href="unclosed>link</a> end</article>')[0] == ["alink end"]
    assert he.blocks("<article><p title=don't>one</p><p \"x>two</p></article>")[0] == ["one", "two"]
    assert he.blocks('<article><p title="a > b">one</p></article>')[0] == ["one"]


@pytest.mark.parametrize("page", ["<div>{}", "<span>{}</b>", "<b><div><span>{}</b>", "<svg>{}", '<a href="x>{}', "<noscript><i>{}"])
def test_time_of_deep_pages_is_linear(page):
    def seconds(n):
        text = page.format("t ") * n
        begin = time.process_time()
        he.blocks(text)
        return time.process_time() - begin

    seconds(1000)
    assert seconds(40_000) < 10 * max(seconds(10_000), 0.02)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>", 7, "y")], SCHEMA + ", host long, text string")
    assert [(r["text"], r["n_chars"]) for r in he.extract(df).collect()] == [("x", 1)]
    assert he.extract(df.limit(0)).count() == 0
