"""The methods behind the operators: draws, tiers, entropy, evidence, owners and long texts, each against plain Python."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm_ops import corpus, docs, prose

from tempograin.llm import decontaminate, language, licenses, mixing, secrets, tokens, warc


# 8. The draw is that of Efraimidis and Spirakis.


@pytest.mark.parametrize("bucket", [2000, 4])
def test_draw_is_the_sorted_prefix(spark, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randint(1, 40)) + "#" * rnd.choice([0, 0, 9, 60]), f"s{min(i % 7, 2)}") for i in range(900)]
    d = docs(spark, rows)
    keys = {r["doc_id"]: (r["key"], r["w"], r["text"]) for r in d.select("doc_id", "text", mixing.quality_weight(F.col("text")).alias("w"), mixing.draw_key(mixing.quality_weight(F.col("text"))).alias("key")).collect()}
    for i, (key, w, text) in keys.items():
        assert w == pytest.approx(max(0.05, 1 - 4 * sum(c in "0123456789#$%&*@^~|<>{}[]\\/_=+!" for c in text) / len(text)))
    uniform = [1 - math.exp(-key * w) for key, w, _ in keys.values()]  # exponential with rate w
    assert abs(np.mean(uniform) - 0.5) < 0.04 and abs(np.mean(np.array(uniform) < 0.25) - 0.25) < 0.05 and len(set(uniform)) == len(rows)
    got = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    for source in ("s0", "s1", "s2"):
        mine = sorted((i for i, _, s in rows if s == source), key=lambda i: (keys[i][0], i))
        size = sum(got[i]["size"] for i in mine)
        epochs, rest, upto, partial = int(got[mine[0]]["target"] // size), got[mine[0]]["target"] % size, 0, 0
        for i in mine:
            upto += got[i]["size"]
            extra = upto - got[i]["size"] / 2 <= rest
            partial += extra
            assert got[i]["taken"] == (epochs + extra) * got[i]["size"], (source, i)
        assert source == "s0" and 0 < partial < len(mine) or epochs in (0, 1, 2)


# 5. Tiers.


def test_tokens_of_all_scripts_go_through_the_tiers(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tok = tokens.opened(path)
    texts = ["日本語 のテキスト 😀 ok", "مرحبا بالعالم hello", "नमस्ते दुनिया", "a  b\n c\t d  ", " lead", "x y  z 　w", "᠎ a ᠎b", "tail ", "", " ", "  ", "'s it's I'll", "é" * 3000, "word" * 50_000, "\x1c a \x85b \x1db"]
    texts += [f"x {chr(c)}a{chr(c)}, {chr(c)}" for c in range(0xA0, 0x260)] + [" naïve,;! straße.. ǀǁ: œuvre"]
    rnd = random.Random(4)
    parts = ["日", "😀", " ", "  ", "\n", "ا", "न", "́", "a", "B", "1", "!", "'s", "　", "\x1f", "‍", "﻿", "\U0001f468", "᠎", "ß"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    words = tokens.frequent(spark.createDataFrame([(t,) for t in texts], "text string"), path, most=40)
    assert len(words) == 40
    counter = tokens.Counter(path, tokens.packed(words, path), cache=50)
    counter.whole = None  # no text here holds a special string, so none may be encoded as a whole
    for t in texts * 2:
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t[:50])
    assert len(counter.lengths) <= 90 and len(counter.stretches) <= 50


def test_frequent_pre_tokens_are_the_most_counted(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rnd = random.Random(4)
    texts = [prose(rnd, 50, 100) for _ in range(40)]
    cut = tokens.opened(path).pre_tokenizer.pre_tokenize_str
    tally = Counter(w for t in texts for w, _ in cut(t))
    got = tokens.frequent(spark.createDataFrame([(t,) for t in texts], "text string"), path, most=20)
    assert len(got) == 20 and min(tally[w] for w in got) >= sorted(tally.values())[-20]
    assert tokens.held(("k", 1), path, tokens.packed(got, path), 10) is tokens.held(("k", 1), path, b"", 10)  # a worker's tasks share it


# 7. The scan as a whole.


def brute_entropy(text):
    """Spans of kind entropy, window by window over sets of positions."""
    found = set()
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{24,}", text):
        blocked = {i for a in secrets.ALLOW.finditer(m[0]) for i in range(m.start() + a.start(), m.start() + a.end())}
        pieces, at = [], None
        for i in range(m.start(), m.end() + 1):
            free = i < m.end() and i not in blocked
            if free and at is None:
                at = i
            elif not free and at is not None:
                pieces.append((at, i))
                at = None
        for a, b in pieces:
            parts = [(a, b)] + [(a + p.start(), a + p.end()) for p in re.finditer("[A-Za-z0-9]{24,}", text[a:b]) if len(p[0]) < b - a]
            for x, y in parts:
                s = text[x:y]
                if y - x < 24:
                    continue
                kind = "digit" if s.isdigit() else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "letter" if s.isalpha() else "alnum" if s.isalnum() else "words" if secrets.WORDS.fullmatch(s) else "base64"
                width, bits = secrets.CLASSES[kind]
                for k in range(len(s) - width + 1):
                    c = Counter(s[k : k + width])
                    if -sum(n / width * math.log2(n / width) for n in c.values()) >= bits - 1e-9:
                        found |= set(range(x + k, x + k + width))
    spans = []
    for i in sorted(found):
        if spans and spans[-1][1] == i:
            spans[-1] = (spans[-1][0], i + 1)
        else:
            spans.append((i, i + 1))
    return spans


def test_secret_scan_against_brute_force():
    rnd = random.Random(12)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [low, up, digits, low + up, low + digits, low + up + digits, low + up + digits + "+/=_-", "0123456789abcdef", "0123456789ABCDEF", "ab1", "x"]
    plain = ["example", "some", "words", "path", "2024-01-02", "0123456789", "123e4567-e89b-12d3-a456-426614174000", "/", "_", "-", "=", " ", "é", "漢", "😀", "key="]
    for _ in range(400):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            parts.append(rnd.choice(plain) if rnd.random() < 0.5 else "".join(rnd.choice(rnd.choice(alphabets[:1]) if False else a) for a in [rnd.choice(alphabets)] for _ in range(rnd.randint(5, 60))))
        text = "".join(parts)
        assert [(a, b) for a, k, b in secrets.scan(text) if k == 3] == brute_entropy(text), text


def test_entropy_classes_can_all_be_reached_and_words_stay():
    rnd = random.Random(1)
    found = lambda t: any(k == 3 for _, k, _ in secrets.scan(t))
    digits = sum(found("".join(rnd.choice("0123456789") for _ in range(40))) for _ in range(200))
    letters = sum(found("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40))) for _ in range(200))
    assert digits > 190 and letters > 190
    assert found("key-example-" + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(40)))
    for harmless in ("some-long-slug-of-plain-words-only", "src/main/java/org/sample/service/handlers", "2024-01-02/2024-01-03/2024-01-04", "=" * 60, "a" * 500, "0123456789" * 5, "123e4567-e89b-12d3-a456-426614174000", "the_quick_brown_fox_jumps_over_the_lazy_dog"):
        assert not found(harmless), harmless


def test_long_texts_cost_their_length():
    rnd = random.Random(6)
    noise = "".join(rnd.choice("abcdef0123456789 ") for _ in range(200_000))
    for text in ("é" + "deadbeef" * 4 + " " + "Zq8fT2mXw9LrB4kVn7Hs3JdY é " * 35_000, noise * 5, "a-" * 500_000, "1_" * 500_000):
        t = time.process_time()
        secrets.scan(text)
        assert time.process_time() - t < 4, text[:20]
    for html in ("<meta content-language " * 45_000, "<script>" * 120_000, "<!--" * 250_000, "<html lang " * 90_000, "<" * 1_000_000, "&a" * 500_000, "<style> </style " * 60_000, "<p>é</p>" * 120_000):
        t = time.process_time()
        language.read_page(html)
        assert time.process_time() - t < 2, html[:20]
    text = "é w1 w2 w3 " * 90_000
    t = time.process_time()
    spans = decontaminate.char_spans(text, [(k, k + 1) for k in range(0, 300_000, 2)])
    assert time.process_time() - t < 4 and spans[-1]["last"] == 299_999 and len(spans) == 150_000


# 4. Evidence.


def test_pages_are_read_as_before():
    assert language.read_page('<html lang="fr"><!-- <html lang=de> --><script>a<b</script>x&amp;y<p>z') == ("   x y z", "fr")
    assert language.read_page("<meta http-equiv='content-language' content='de'>a") == (" a", "de") and language.read_page("<meta content=es http-equiv=Content-Language><html LANG = en>") == ("  ", "en")
    assert language.read_page("a <b c") == ("a <b c", None) and language.read_page("<script>x<p>y") == (" x y", None) and language.read_page(None) == ("", None)


def test_beliefs_against_brute_force(spark):
    rnd = random.Random(7)
    words = {"en": "the and with that from this which their".split(), "fr": "le la les des une pour avec cette".split(), "de": "der die und nicht ein für über durch".split()}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    d = spark.createDataFrame([(i, lang, text(lang, 40)) for i in range(200) for lang in [rnd.choice(list(words))]], "doc_id long, lang string, text string")
    languages, table = language.learn_language_model(d)
    rows = []
    for i in range(150):
        lang = rnd.choice(languages)
        host = rnd.choice([f"{lang}.site.com", f"h{i % 5}.other.de", f"www.third.co.{rnd.choice(['uk', 'fr'])}", "lone.net"])
        html = None if i % 29 == 0 else f'<html lang="{rnd.choice([lang, lang, "en", "xx"])}">{text(lang, rnd.choice([0, 1, 2, 12]))}'
        rows.append((i, f"http://{host}/{rnd.choice(['', 'fr/', 'a/'])}", html))
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), languages, table).collect()}
    n, S, seen = len(languages), language.SMOOTH, {}
    counts = {level: defaultdict(lambda: [[0.0] * n, 0]) for level in ("host", "domain", "suffix", "all")}
    for i, url, html in rows:
        host, domain, suffix, told = language.address(url, set(languages))
        visible, declared = language.read_page(html)
        score = language.text_scores(visible, table)
        own = None
        if score.max() > score.min():
            e = [math.exp(x) for x in score]
            own = [x / sum(e) for x in e]
            for level, key in (("host", host), ("domain", (domain, suffix)), ("suffix", suffix), ("all", "")):
                cell = counts[level][key]
                cell[0] = [a + b for a, b in zip(cell[0], own)]
                cell[1] += 1
        seen[i] = (host, domain, suffix, told, declared if declared in languages else None, score, own, own and languages[max(range(n), key=lambda k: (own[k], -k))])
    drawn = lambda cell, above: [(c + S * a) / (cell[1] + S) for c, a in zip(cell[0], above)]
    world = drawn(counts["all"][""], [1 / n] * n)
    trust = []
    for k in (4, 3):
        both = [(v[k], v[7]) for v in seen.values() if v[k] and v[7]]
        trust.append(min(0.98, max(1 / n, (sum(a == b for a, b in both) + 4) / (len(both) + 5))))
    for i, (host, domain, suffix, told, declared, score, own, _) in seen.items():
        above = drawn(counts["domain"][(domain, suffix)], drawn(counts["suffix"][suffix], world))
        c, m = counts["host"][host]
        mine = own or [0.0] * n
        prior = [(max(c[k] - mine[k], 0) + S * above[k]) / (m - (own is not None) + S) for k in range(n)]
        total = [score[k] + math.log(prior[k]) for k in range(n)]
        for r, says in zip(trust, (declared, told), strict=True):
            if says:
                total = [t + math.log(r if languages[k] == says else max(1e-9, 1 - r) / max(1, n - 1)) for k, t in enumerate(total)]
        e = [math.exp(t - max(total)) for t in total]
        best = max(range(n), key=lambda k: e[k])
        assert got[i]["lang"] == languages[best] and got[i]["confidence"] == pytest.approx(e[best] / sum(e), abs=2e-6), i


def test_a_thousand_languages(spark):
    names = [f"l{k:03d}" for k in range(1000)]
    rnd = np.random.default_rng(1)
    table = np.log(rnd.dirichlet(np.full(language.BUCKETS, 0.3), 1000) + 1e-9).astype(np.float32)
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.site.com/", f"<html lang=l{i % 1000:03d}>some words of page {i}") for i in range(400)], "page_id long, url string, html string")
    t = time.time()
    got = language.identify(pages, names, table).collect()
    assert len(got) == 400 and all(r["lang"] in names and 0 < r["confidence"] <= 1 for r in got) and time.time() - t < 60


# 6. Owners.


def test_a_passage_of_many_owners_in_many_documents():
    passage = "one two three four five six seven eight"
    phrases = decontaminate.Phrases([(f"i{k:05d}", passage) for k in range(10_000)])
    assert len(phrases.table) == 1 and len(phrases.names) == 10_000
    words = phrases.numbers(f"{passage} and {passage} " * 40)
    t = time.process_time()
    out = decontaminate.hits([words] * 20, phrases)
    assert time.process_time() - t < 5 and all(len(items) == 10_000 and len(spans) == 41 for spans, items in out)


def test_blocks_count_as_one(spark):
    rnd = random.Random(3)
    rows = corpus(11)
    items = [(k, prose(rnd, rnd.choice([3, 8, 30]), 60)) for k in range(20)] + [(20, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, some = ({(r["doc_id"], r["text"], r["n_words"], r["n_hit"], tuple(r["items"]), str(r["spans"])) for r in decontaminate.benchmark_hits(docs(spark, rows), bench, block_bytes=b).collect()} for b in (1 << 20, 200))
    assert one == some


# 2 and 10.


def test_many_notices_in_one_text(spark):
    notice = licenses.NOTICES["MIT"][1]
    rnd = random.Random(5)
    text = " ".join(f"{notice} {prose(rnd, 3)}" for _ in range(2000))
    got = licenses.license_matches(docs(spark, [(1, text), (2, notice), (3, prose(rnd, 500))])).collect()
    assert {r["doc_id"]: [(m["license"], m["containment"]) for m in r["matches"]] for r in got} == {1: [("MIT", 1.0)], 2: [("MIT", 1.0)], 3: []}


def test_windows_that_hold_enough_of_a_notice_are_retrieved(spark):
    """Recall of the bands against every window's exact containment, with notices from which words are missing."""
    rnd = random.Random(15)
    rows = []
    for i in range(300):
        words = rnd.choice([t for ts in licenses.NOTICES.values() for t in ts]).split()
        for _ in range(rnd.choice([0, 0, 1])):
            words[rnd.randrange(len(words))] = "other"
        rows.append((i, f"{prose(rnd, rnd.randint(0, 90))} {' '.join(words)} {prose(rnd, rnd.randint(0, 90))}"))
    want = set()
    for i, text in rows:
        w = licenses.template_words(text)
        for name, texts in licenses.NOTICES.items():
            for t in texts:
                tw = licenses.template_words(t)
                mine = {tuple(tw[k : k + 5]) for k in range(len(tw) - 4)}
                size = licenses.window_class(len(mine))
                for j in range(0, max(1, len(w)), size // 2):
                    held = {tuple(w[k : k + 5]) for k in range(j, min(j + size, len(w) - 4))}
                    if len(held & mine) / len(mine) >= licenses.LEAST:
                        want.add((i, name))
    got = {(r["doc_id"], m["license"]) for r in licenses.license_matches(docs(spark, rows)).collect() for m in r["matches"]}
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 200


def test_pages_without_a_broadcast(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, f"u{i}", rnd.choice(["same", "", None, f"own {i}"])) for i in range(200)] + [(7, "again", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda: Counter(map(tuple, warc.read_records(warc.write_pages(pages)).collect()))
    one = read()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert read() == one and sum(one.values()) == 201


# 3. Held-out accuracy on the test tables' own labels.


def test_quality_on_held_out_labels(spark):
    import os

    at = "/root/testdata/sf0.01"
    if not os.path.exists(f"{at}/labels.parquet"):
        pytest.skip("no test tables")
    from tempograin.llm.queries import QUERIES

    scored = QUERIES["op3_quality"](spark, at)
    held = scored.join(spark.read.parquet(f"{at}/labels.parquet").where("quality is not null").select("doc_id", "quality"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
