import random
import re

import pytest

from sievelake.llm.licenses import TEMPLATES, Automaton, parse, scan_licenses, split_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = {
    "one": 'may use<<beginOptional>>, copy<<beginOptional>> or sell<<endOptional>><<endOptional>> this <<var;name="w";match="work|software library">> freely',
    "two": '<<beginOptional>>you <<endOptional>>may <<var;name="x";match=".{0,3}">> this',
    "tail": 'by <<var;name="x";match=".+">> end<<beginOptional>> end<<endOptional>>',
    "word": "freely",
}


def regex(parts):
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += re.escape(p) + " "
        elif p[0] == "optional":
            out += f"(?:{regex(p[1])})?"
        elif p[0] == "any of":
            out += "(?:" + "|".join("".join(re.escape(w) + " " for w in x) for x in p[1]) + ")"
        else:
            out += r"(?:\S+ ){%d,%d}" % p[1:]
    return out


def brute(text, templates):
    w, out = split_words(text or ""), []
    for name, t in templates.items():
        pattern, free = re.compile(regex(parse(t))), 0
        for i in range(len(w)):
            best = max((j for j in range(i + 1, len(w) + 1) if pattern.fullmatch("".join(x + " " for x in w[i:j]))), default=None)
            if best and i >= free:
                free = best
                out.append((name, i, best - i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = "you may use copy or sell this work software library freely by end end é x , .".split()
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 30, 90]))), "en", "s", 1) for i in range(120)]
    rows += [(500 + i, f"x {random.Random(i).choice(['may use THIS work freely', 'May use, copy or sell this Software-Library: freely.', 'by a b c end end'])} y", "en", "s", 1) for i in range(9)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA), SMALL).collect()
    assert sorted((r.doc_id, r.license, r.start, r.words) for r in got) == sorted((d, *m) for d, t, *_ in rows for m in brute(t, SMALL))


def test_production_templates(spark):
    original = {n: re.sub(r'<<var;[^>]*original="([^"]*)"[^>]*>>', r"\1", t) for n, t in TEMPLATES.items()}
    full = {n: re.sub(r"<<(begin|end)Optional>>", " ", t) for n, t in original.items()}
    bare = {n: re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", re.sub(r"<<beginOptional>>(?:(?!<<).)*<<endOptional>>", " ", t, flags=re.S), flags=re.S) for n, t in original.items()}
    rows = [(i, f"Intro text. {t} and more", n, "s", 1) for i, (n, t) in enumerate([*full.items(), *bare.items()])]
    broken = [(100 + i, "Intro " + " ".join(w for k, w in enumerate(t.split()) if k != len(t.split()) - 2), n, "s", 1) for i, (n, t) in enumerate(bare.items())]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows + broken, SCHEMA)).collect()}
    assert all((d, n) in got for d, _, n, *_ in rows)
    assert not any((d, n) in got for d, _, n, *_ in broken)


def test_defined_cases(spark):
    notice = "Released under the MIT License."
    rows = [(None, notice, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "?!", "en", "s", 0), (4, notice, "en", "s", 1), (4, notice, "en", "s", 1), (5, "word " * 100000 + notice, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as license", "2 as words")
    got = sorted(((r.doc_id, r.license, r.start, r.words) for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted([(None, "MIT-notice", 0, 5), (4, "MIT-notice", 0, 5), (4, "MIT-notice", 0, 5), (5, "MIT-notice", 100000, 5)], key=str)
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", 'a <<var;name="x";match="[a-z]+">>', '<<var;name="x";match=".+">> a', "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        Automaton({"t": bad})


def test_full_texts_and_long_holders(spark):
    holder = " ".join(f"Holder{i}" for i in range(45))
    mit = re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r'<<var;name="holder"[^>]*>>', holder, TEMPLATES.get("MIT", "")))
    texts = {
        "MIT": re.sub(r'<<var;[^>]*original="(.*?)";match[^>]*>>', r"\1", mit),
        "Zlib": re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r'<<var;name="holder"[^>]*>>', holder, TEMPLATES["Zlib"])),
        "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + "terms " * 2500 + "END OF TERMS AND CONDITIONS",
        "LGPL-2.1-header": f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by {holder}; either version 2.1 of the License, or later",
        "CC-BY-SA-4.0-license": "This page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    rows = [(i, f"Intro. {t} More.", "en", "s", 1) for i, t in enumerate(texts.values())]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(i, n) for i, n in enumerate(texts)} <= got
