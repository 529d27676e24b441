"""SimHash groups, weighted sampling, decontamination, HTML and licences against brute-force versions."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents, empty, sentence

from ostiary.llm import decontaminate, html_text, license_scan, simhash, weighted_sampling


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", _lower(text)) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def _components(fingerprints, radius=4):
    ids = sorted(fingerprints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fingerprints[i] ^ fingerprints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _similar_texts(rng):
    base = [sentence(rng, words=rng.randint(1, 300)) for _ in range(40)]
    copies = []
    for _ in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        copies.append(" ".join(words))
    return ODD + base + copies + base[:5] * 3


def test_simhash_groups(spark):
    texts = _similar_texts(random.Random(1))
    docs = simhash.with_fingerprint(documents(spark, texts).drop("fp"))
    rows = docs.join(simhash.components(docs.select("doc_id", "fp")), "fp").select("doc_id", simhash.hex_digits("fp").alias("h"), "component_id").collect()
    fingerprints = {i: _fingerprint(t) for i, t in enumerate(texts)}
    groups = _components(fingerprints)
    assert len(rows) == len(texts) and len(set(groups.values())) < len(texts) - 20
    for row in rows:
        assert (row["h"], row["component_id"]) == (f"{fingerprints[row['doc_id']]:016x}", groups[row["doc_id"]])


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_forest_keeps_every_link(monkeypatch, radius):
    monkeypatch.setattr(simhash, "SUB_TILE", 16)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2 ** 64, 60, dtype=np.uint64)
    near = [w ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False))) for w in np.repeat(words, 3)]
    both = np.unique(np.concatenate([words, np.array(near, np.uint64)]))
    want = _components(dict(enumerate(both.tolist())), radius)
    number = {int(w): i for i, w in enumerate(both.tolist())}
    for cut in (0, 50, 100):
        parts = [(both, None)] if not cut else [(both[:cut], None), (both[cut:], None), (both[:cut], both[cut:])]
        parent = np.arange(len(both))
        edges = 0
        for left, right in parts:
            a, b = simhash.forest(left, right, radius)
            edges += len(a)
            pairs = [(number[int(x)], number[int(y)]) for x, y in zip(a.view(np.uint64), b.view(np.uint64))]
            assert all(bin(int(both[x]) ^ int(both[y])).count("1") <= 64 for x, y in pairs)
            if pairs:
                simhash._join(parent, *np.array(pairs).T)
        assert [int(r) for r in simhash._roots(parent, np.arange(len(both)))] == [want[i] for i in range(len(both))]
        assert edges <= len(both) * len(parts)


def _jaccard(a, b):
    a, b = Counter(_lower(a).split()), Counter(_lower(b).split())
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(4)
    known = weighted_sampling.common.WordMemo(weighted_sampling.draws)
    errors = []
    for _ in range(150):
        a = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 120))]
        b = a[:rng.randint(0, len(a))] + [rng.choice("abcdefghijuvwxyz") for _ in range(rng.randint(1, 60))]
        a, b = " ".join(a), " ".join(b)
        errors.append(weighted_sampling.likeness(weighted_sampling.signature(a, known), weighted_sampling.signature(b, known)) - _jaccard(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.07


def test_edited_texts(spark):
    rng = random.Random(5)
    texts = ODD + [sentence(rng, words=rng.randint(1, 200)) for _ in range(50)]
    rows = {r["doc_id"]: r for r in weighted_sampling.compare_with_edited(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        own, following = text or "", texts[i - 1] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        assert rows[i]["n_chars"] == len(own) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["near_next"] == pytest.approx(_jaccard(own, following), abs=0.3)
    assert rows[1]["fingerprint"] == "" and rows[2]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in weighted_sampling.with_fingerprint(documents(spark, texts)).collect()}
    assert all(plain[i] == rows[i]["fingerprint"] for i in plain)


def test_edited_texts_of_repeated_and_few_rows(spark):
    docs = spark.createDataFrame([(None, "n m"), (7, "a b c"), (7, "a b c"), (7, "d e f")], "doc_id long, text string")
    rows = weighted_sampling.compare_with_edited(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 3), (7, 5), (7, 5), (7, 5)]
    one = weighted_sampling.compare_with_edited(docs.filter("doc_id IS NULL")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert weighted_sampling.compare_with_edited(empty(spark)).count() == 0


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(text, items, window=10):
    words = _WORD.findall(_lower(text))
    hit, owners = set(), set()
    for item, body in items:
        own = _WORD.findall(_lower(body))
        size = min(window, len(own))
        for at in range(len(own) - size + 1) if own else ():
            for start in range(len(words) - size + 1):
                if words[start:start + size] == own[at:at + size]:
                    hit |= set(range(start, start + size))
                    owners.add(str(item))
    return len(words), hit, sorted(owners)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice(["en", "fr"]), rng.choice([2, 5, 9, 10, 11, 30]))) for i in range(25)] + [(3, "again 3"), (90, None), (91, "..."), (None, "th er")]
    texts = list(ODD)
    for _ in range(120):
        words = sentence(rng, words=rng.randint(1, 80)).split()
        if rng.random() < 0.6:
            at, passage = rng.randrange(len(words)), (rng.choice(items[:25])[1]).split()
            start = rng.randrange(len(passage))
            words[at:at] = [w.capitalize() for w in passage[start:start + rng.randint(1, 20)]]
        texts.append(rng.choice([" ", ", ", " — "]).join(words))
    table = spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.decontaminate(documents(spark, texts), table).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        n, hit, owners = _hits(text, [i for i in items if i[0] is not None])
        assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (n, len(hit), owners, bool(hit))
        covered = [w for s in row["spans"] for w in _WORD.findall(_lower(text[s["start"]:s["end"]]))]
        words = _WORD.findall(_lower(text))
        assert covered == [words[i] for i in sorted(hit)]
    assert decontaminate.decontaminate(empty(spark), table).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(documents(spark, texts), table.limit(0)).collect())


PAGE = """<!DOCTYPE html><html><head><title>T, a, b, c</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site, with, many, commas</h1></header><nav><ul><li><a href="/a">a menu entry, long enough to be text</a></li></ul></nav>
<div id="cookie-notice">We use cookies, and more, and more, and so on, for a long while.</div>{body}
<aside><p>Elsewhere, there is, yet more, text, to read.</p></aside><div class="ad">Buy, now, this, fine, thing.</div>
<section id="comments"><article class="comment"><p>Nice, post, I, like, it, a lot.</p></article></section><footer>&copy; someone</footer></body></html>"""


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ('<div class="post-content">', "</div>"), ("<main>", "</main>"), ("<div><div>", "</div></div>")])
def test_html_article(open_, close):
    body = (f"{open_}<h1>Title &amp;amp; more</h1><p>First&nbsp;paragraph,\n with <b>bold</b> and <a href=x>a link</a>, long enough to count.</p>"
            "<p><i>Second<br>line &lt;b&gt; &eacute;<p>Unclosed, third.<!-- <p>gone</p> --><ul class=share><li>tweet this</ul>"
            f"<form>your mail <input></form><blockquote>A quote.</blockquote>{close}")
    want = "Title &amp; more First paragraph, with bold and a link, long enough to count. Second line <b> é Unclosed, third. A quote."
    assert html_text.main_text(PAGE.format(body=body)) == want


def test_html_rows(spark):
    pages = [None, "", "   ", "no markup, just text", "<p>x", "<", "<p a='", "<script>never closed", "<div>" * 3_000 + "deep", PAGE.format(body="<article><p>" + "long, " * 20_000 + "</article>")]
    table = spark.createDataFrame([(i, p, i) for i, p in enumerate(pages)], "page_id int, html string, text int")
    rows = {r["page_id"]: r for r in html_text.extract(table).collect()}
    assert [rows[i]["text"] for i in range(5)] == ["", "", "", "no markup, just text", "x"]
    assert rows[8]["text"] == "deep" and rows[9]["n_chars"] == len(("long, " * 20_000).strip())
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert html_text.extract(table.limit(0)).count() == 0


def test_html_of_the_given_pages(spark):
    """The template of the synthetic pages: everything inside the article, by a plain regular expression."""
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)
        if article:
            text = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article[1]))
            assert html_text.main_text(row["html"]) == " ".join(html.unescape(text).split())


def test_license_scan(spark):
    rng = random.Random(7)
    filler = [sentence(rng, words=60) + "." for _ in range(4)]
    changed = license_scan.TEMPLATES["MIT-text"].replace("free of charge", "at no cost")
    texts = ODD + [
        "\n".join([filler[0], "Released under the MIT License.", filler[1]]),
        "\n".join([filler[0], "Licensed under CC BY-NC 4.0.", filler[1], filler[2], filler[3], "Licensed under the Apache License, Version 2.0."]),
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + changed + "\n\n" + filler[0],
        "All rights reserved. A licence to talk, with warranty.", "Released under the MIT License. Released under the MIT License."]
    rows = {r["doc_id"]: r["licenses"] for r in license_scan.scan(documents(spark, texts)).collect()}
    found = {i: [f["license"] for f in own] for i, own in rows.items()}
    start = len(ODD)
    assert found == {**{i: [] for i in range(start)}, start: ["MIT"], start + 1: ["CC-BY-NC-4.0", "Apache-2.0"], start + 2: ["MIT-text"], start + 3: ["reserved"], start + 4: ["MIT", "MIT"]}
    notice = rows[start][0]
    assert texts[start][notice["start"]:notice["end"]] == "Released under the MIT License" and notice["missing"] == notice["added"] == []
    assert (rows[start + 2][0]["missing"], rows[start + 2][0]["added"]) == (["free", "of", "charge"], ["at", "no", "cost"])
    for name, template in license_scan.TEMPLATES.items():  # every template finds itself, without a difference
        assert [(f.license, f.missing, f.added) for f in license_scan.scan_text(template, license_scan.Templates(license_scan.TEMPLATES), {})] == [(name, [], [])], name
    assert license_scan.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("line, want", [
    ("Licensed under the GNU General Public License, version 2.", "GPL-2.0-name"), ("This work is licensed under the GNU General Public License, version 2.0.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("Released under the BSD License.", "BSD"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-name"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), ("Licensed under the Apache License, Version 1.1.", None),
    ("All rights reserved.", "reserved"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Licensed under CC BY-NC 3.0.", None),
    ("This work is licensed under the GNU Public License, version 3.", None)])
def test_names_and_versions_of_licenses(line, want):
    found = license_scan.scan_text(f"Some words before.\n{line}\nAnd some after it.", license_scan.Templates(license_scan.TEMPLATES), {})
    assert [f.license for f in found] == ([want] if want else [])


def test_licenses_by_brute_force():
    """Every sentence's winner has the fewest differences among all templates whose wording is near and names the same licence."""
    import difflib

    known = license_scan.Templates(license_scan.TEMPLATES)
    rng = random.Random(12)
    for name, template in sorted(license_scan.TEMPLATES.items()):
        words = template.split()
        for _ in range(3):
            changed = list(words)
            if len(words) > 12:
                for _ in range(2):
                    i = rng.randrange(len(changed))
                    if license_scan._spelled(changed[i].strip("().,;:\"")) not in license_scan.NAMING and not changed[i][0].isdigit():
                        changed[i] = "other"
            block = [license_scan._spelled(w) for w in license_scan._WORD.findall(" ".join(changed))]
            best = []
            for other, own in ((n, w) for n, w, _, _ in known.known):
                steps = difflib.SequenceMatcher(None, own, block, autojunk=False).get_opcodes()
                equal = [x for x in steps if x[0] == "equal"]
                if not equal or sum(x[2] - x[1] for x in equal) < license_scan.LEAST_WORDING * len(own):
                    continue
                missing = [w for x in steps if x[0] != "equal" for w in own[x[1]:x[2]]]
                added = [w for x in steps if x[0] != "equal" and equal[0][3] <= x[3] and x[4] <= equal[-1][4] for w in block[x[3]:x[4]]]
                if not license_scan._renames(missing, added):
                    best.append((len(missing) + len(added), -len(own), other))
            found = known.best(" ".join(changed))
            assert (found.license if found else None) == min(best)[2], (name, changed)
            assert changed != words or found.license == name


def test_license_notices_inside_long_lines():
    known = license_scan.Templates(license_scan.TEMPLATES)
    notice = "Released under the MIT License"
    words = [sentence(random.Random(9), words=n) for n in (4, 40, 3_000)]
    for before in words:
        for after in words:
            line = f"{before} | {notice} | {after} | Licensed under CC BY-NC 4.0 | {before}"
            found = license_scan.scan_text(line, known, {})
            assert [(f.license, f.missing, f.added) for f in found] == [("MIT", [], []), ("CC-BY-NC-4.0", [], [])]
            assert line[found[0].start:found[0].end] == notice
    menu = "About us | Contact | Released under the MIT License | Privacy policy | Terms | Help | Jobs | Press | Blog"
    assert [f.license for f in license_scan.scan_text(menu, known, {})] == ["MIT"]


@pytest.mark.parametrize("open_, close", [
    ("<article class='post has-comments'>", "</article>"), ("<main class='with-sidebar'>", "</main>"), ("<div id='content' class='menu-open'>", "</div>"),
    ("<div id='page' class='no-sidebar'><main class='with-sidebar'><article class='post has-comments'>", "</article></main></div>")])
def test_html_article_with_alien_words_in_its_names(open_, close):
    paragraphs = ["The first paragraph, long enough to count, has some commas, and goes on.", "The second one, too, is as long as it has to be, and ends."]
    inner = "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class='post-share'>tweet this</div>"
    assert html_text.main_text(PAGE.format(body=open_ + inner + close)) == " ".join(paragraphs)


_SAYS = "I read this with interest, although, as others said, some of it was known before, and I doubt the rest of it, too."


@pytest.mark.parametrize("name", ["post-comments", "comment-body", "entry-comments", "comments-content", "article-comments", "comments", "replyList", "page-footer", "site-footer", "sponsored-content"])
@pytest.mark.parametrize("inside", [True, False])
def test_readers_comments_and_footers_go(name, inside):
    paragraphs = [f"Paragraph {i} of the article, with words, and more words, so that it counts for something." for i in range(4)]
    article = "".join(f"<p>{p}</p>" for p in paragraphs)
    box = f'<div class="{name}">' + f"<p>{_SAYS}</p>" * 8 + "</div>"
    body = f'<div class="entry-content">{article}{box if inside else ""}</div>{"" if inside else box}'
    assert html_text.main_text(f"<html><body>{body}</body></html>") == " ".join(paragraphs)


@pytest.mark.parametrize("open_, close", [("<form id='aspnetForm'>", "</form>"), ("<div class='sidebar-layout'>", "</div>"), ("<div class='modal social'><div>", "</div></div>"),
                                          ("<div id='content' class='menu-open'>", "</div>"), ("<main class='with-sidebar'>", "</main>"), ("<form><div class='post'>", "</div></form>")])
def test_elements_around_the_whole_page_are_containers(open_, close):
    paragraphs = [f"Paragraph {i} of the article, with words, and more words, so that it counts for something." for i in range(6)]
    body = open_ + "<nav><a href='/'>Home</a></nav>" + "".join(f"<p>{p}</p>" for p in paragraphs) + close
    assert html_text.main_text(f"<html><body>{body}</body></html>") == " ".join(paragraphs)
    search = "<form><p>Search here</p><input></form><div class='related'><p>See this, too</p></div>"
    assert html_text.main_text(f"<html><body>{body}{search}</body></html>") == " ".join(paragraphs)
