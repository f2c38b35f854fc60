"""License templates against regular expressions over every range of words."""

import random
import re

import pytest

from telemetra.llm import licenses

PLAIN = re.compile(r"<<.*?>>", re.S)


def pattern(markup: str) -> re.Pattern:
    """The same template as a regular expression, every word followed by a space."""
    out = ""
    for k, part in enumerate(licenses.TAG.split(markup)):
        if k % 2 == 0:
            out += "".join(re.escape(w.decode()) + " " for w in licenses.words(part))
        elif part.endswith("Optional"):
            out += "(?:" if part.startswith("begin") else ")?"
        else:
            out += "(?:[^ ]+ ){%s,%s}" % tuple(re.search(r'words="(\d+)-(\d+)"', part).groups())
    return re.compile(out)


def brute(tokens, templates):
    """Leftmost, then longest, over all ranges."""
    found = []
    for name, (label, markup) in templates.items():
        own, at = pattern(markup), 0
        while at < len(tokens):
            ends = [e for e in range(len(tokens), at, -1) if own.fullmatch("".join(t + " " for t in tokens[at:e]))]
            if ends:
                found.append((label, name, at, ends[0]))
                at = ends[0]
            else:
                at += 1
    return outer(found)


def outer(found):
    inside = lambda x, y: y[2] <= x[2] and x[3] <= y[3] and x[2:] != y[2:]
    return sorted((x for x in found if not any(inside(x, y) for y in found)), key=lambda x: (x[2], x[3], x[1]))


def test_small_templates_equal_regular_expressions():
    rnd = random.Random(13)
    templates = {
        "one": ("x", 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d<<var;name="v";words="0-2">> a'),
        "two": ("y", "<<beginOptional>>c<<endOptional>> b b <<beginOptional>>a<<endOptional>>"),
        "three": ("z", 'd <<var;name="v";words="1-3">> d <<var;name="w";words="0-1">> c'),
        "four": ("x", "<<beginOptional>>a<<endOptional>><<beginOptional>>b<<endOptional>> c<<beginOptional>>c c<<endOptional>>"),
    }
    own = licenses.Scanner(templates)
    hits = 0
    for _ in range(600):
        tokens = [rnd.choice("abcde") for _ in range(rnd.randrange(14))]
        got = own.scan([t.encode() for t in tokens])[1]
        assert got == brute(tokens, templates), tokens
        hits += len(got)
    assert hits > 500


def filled(markup: str, optional: bool) -> str:
    """A text that a template must accept, with or without its optional words."""
    if not optional:
        while "beginOptional" in markup:
            markup = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", markup, count=1, flags=re.S)
    least = lambda m: " " + " ".join(f"Name{i}" for i in range(int(m[1]))) + " "
    return PLAIN.sub(" ", re.sub(r'<<var;[^>]*words="(\d+)-\d+">>', least, markup))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_mandatory_wording(name):
    label, markup = licenses.TEMPLATES[name]
    own = licenses.Scanner({name: (label, markup)})
    for optional in (False, True):
        text = filled(markup, optional)
        inside = licenses.words("some words before. " + text + " and words behind")
        spans = own.scan(inside)[1]
        assert [x[:2] for x in spans] == [(label, name)], text
        assert spans[0][2] <= 3 + (optional and len(licenses.words(text))) and spans[0][3] >= 3 + len(licenses.words(filled(markup, False)))
        mandatory = licenses.words(filled(markup, False))
        for k in range(0, len(mandatory), max(1, len(mandatory) // 7)):  # one mandatory word differs
            if mandatory[k].startswith(b"name"):
                continue
            assert own.scan([*mandatory[:k], b"zzz", *mandatory[k + 1 :]])[1] == [], (name, k)


def test_full_texts():
    own = licenses.Scanner(licenses.TEMPLATES)
    labels = lambda text: sorted({x[0] for x in own.scan(licenses.words(text))[1]})
    mit = filled(licenses.TEMPLATES["mit-text"][1], True)
    assert labels(mit) == ["mit"] and labels(mit.replace("sublicense", "lend")) == []
    assert labels(filled(licenses.TEMPLATES["bsd-3-clause-text"][1], True)) == ["bsd-3-clause"]
    assert labels(filled(licenses.TEMPLATES["bsd-2-clause-text"][1], False)) == ["bsd-2-clause"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"] and labels("Licensed under CC BY 4.0.") == ["cc-by"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache"]
    assert labels("we met at the license office") == []


def test_rows(spark):
    texts = [
        None, "", " \n ", "Released under the MIT License. mit LICENSE", "é — Licensed under\n the Apache\tLicense, Version 2.0 ü",
        "general public general public license license", "x " * 20_000 + "mit license" + " y" * 20_000, "MIT-License mit_license mitlicense",
        "MIT License mit license MIT", "plain words",
    ]
    schema = "doc_id long, text string, base string, found string, score string, n_words string"
    rows = [(i, t, "b", "f", "s", "n") for i, t in enumerate(texts)] + [(3, texts[3], "b", "f", "s", "n"), (None, "mit license", "", "", "", "")]
    frame = spark.createDataFrame(rows, schema)
    got = licenses.scan(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        tokens = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        want = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(tokens)) if tokens[k : k + len(p.split())] == p.split())
        assert by[i].n_words == len(tokens) and [(x.word, x.label) for x in by[i].base] == want
        for x in [*by[i].base, *by[i].found]:
            assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t[x.start : x.end].lower()) == tokens[x.word : x.end_word]
    assert by[4].score == pytest.approx(8 / 11) and by[3].score == pytest.approx(1) and by[0].score == 0
    assert [x.template for x in by[3].found] == ["mit-notice"]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_query(spark, sf, con):
    got = {r.doc_id: r for r in licenses.op13_template_automata(spark, sf).collect()}
    want = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(want)
    for i, text in want:
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(tokens)) if tokens[k : k + len(p.split())] == p.split()]
        line = "".join(t + " " for t in tokens)
        spans = [(x, n, m.start(), m.end()) for n, (x, markup) in licenses.TEMPLATES.items() for m in re.finditer(r"(?<![^ ])" + pattern(markup).pattern, line)]
        found = {x[0] for x in outer(spans)}
        r = got[i]
        assert (r.n_words, r.n_base) == (len(tokens), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted({x for _, x in places} | found))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
