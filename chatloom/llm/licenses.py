"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser
evaluates licence expressions.

Texts are lower-cased (A-Z) and cut into words, runs of ASCII letters and digits and of
all characters beyond ASCII. The automaton reads the words joined by spaces, so a
phrase is found wherever its words stand consecutively, overlaps included. Where it
finds the words of an identifier tag, the expressions after the tags of the raw text are
parsed: ``and``, ``or`` and ``with`` in the order of strength with, and, or; parentheses.

score: how freely the document may be used, 0 to 1: each licence has a grade; ``or``
takes the better side, ``and`` the worse, ``with`` adds a little for the exception; of
several notices the worst counts. 0 where nothing is found.

Labels are of notices, and of the tags' names that are known identifiers or begin with
LicenseRef-; an unknown name still counts for the score.

Cases: a null text is empty. An expression that doesn't parse counts by its licence
names alone, joined by ``and``. Repeated rows are scanned one by one; an empty table
gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from chatloom.llm.arrow import map_texts

# The base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Names of licences as the public list of identifiers has them, by family, with the family's versions
# ("-": the name alone is one, too) and, in words, what a notice calls it.
FAMILIES = {
    "academic": ("afl", "1.1 1.2 2.0 2.1 3.0", "academic free"), "affero": ("agpl", "1.0 3.0", "affero general public"),
    "apache": ("apache", "1.0 1.1 2.0", "apache"), "apple": ("apsl", "1.0 1.1 1.2 2.0", "apple public source"),
    "artistic": ("artistic", "1.0 2.0", "artistic"), "boost": ("bsl", "1.0", "boost software"),
    "bsd": ("bsd", "1-clause 2-clause 3-clause 4-clause", "bsd"), "cddl": ("cddl", "1.0 1.1", "common development and distribution"),
    "cecill": ("cecill", "1.0 1.1 2.0 2.1", "cecill"), "common": ("cpl", "1.0", "common public"),
    "by": ("cc-by", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution"), "by-nc": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution noncommercial"),
    "by-nd": ("cc-by-nd", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution noderivatives"), "by-sa": ("cc-by-sa", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution sharealike"),
    "by-nc-nd": ("cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution noncommercial noderivatives"),
    "by-nc-sa": ("cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0", "creative commons attribution noncommercial sharealike"),
    "cc0": ("cc0", "1.0", "cc0 universal"), "educational": ("ecl", "1.0 2.0", "educational community"), "eiffel": ("efl", "1.0 2.0", "eiffel forum"),
    "eclipse": ("epl", "1.0 2.0", "eclipse public"), "european": ("eupl", "1.0 1.1 1.2", "european union public"),
    "documentation": ("gfdl", "1.1 1.2 1.3", "free documentation"), "general": ("gpl", "1.0 2.0 3.0", "general public"),
    "ibm": ("ipl", "1.0", "ibm public"), "project": ("lppl", "1.0 1.1 1.2 1.3a 1.3c", "latex project public"),
    "lesser": ("lgpl", "2.1 3.0", "lesser general public"), "library": ("lgpl", "2.0", "library general public"),
    "mozilla": ("mpl", "1.0 1.1 2.0", "mozilla public"), "microsoft": ("ms", "pl rl", "microsoft public"), "mulan": ("mulanpsl", "1.0 2.0", "mulan permissive software"),
    "database": ("odbl", "1.0", "open database"), "open-data": ("odc-by", "1.0", "open data commons attribution"), "font": ("ofl", "1.0 1.1", "open font"),
    "open-ldap": ("oldap", "2.0 2.1 2.2 2.3 2.4 2.5 2.6 2.7 2.8", "openldap public"), "open-software": ("osl", "1.0 1.1 2.0 2.1 3.0", "open software"),
    "php": ("php", "3.0 3.01", "php"), "python": ("psf", "2.0", "python software foundation"), "zope": ("zpl", "1.1 2.0 2.1", "zope public"),
}
SINGLE = (
    "0bsd afl curl beerware bsd-source-code clarityax dsdp fair ftl gl2ps hpnd icu ijg imlib2 info-zip intel isc jasper-2.0 json libpng libtiff mit mit-0 "
    "mit-cmu miros mtll multics naumen ncsa net-snmp nlod-1.0 ntp openssl postgresql python-2.0 qhull qpl-1.0 ruby sax-pd sgi-b-2.0 sissl sleepycat "
    "spencer-94 tcl tcp-wrappers unicode-dfs-2016 unlicense upl-1.0 vim w3c watcom-1.0 wtfpl x11 xfree86-1.1 xinetd xnet zed zlib zlib-acknowledgement"
).split()
#: Families whose versions are also named "-only" and "-or-later".
GNU = ("agpl", "gfdl", "gpl", "lgpl")


def identifiers() -> set[str]:
    """Every identifier, in lower case."""
    found = set(SINGLE)
    for name, versions, _ in FAMILIES.values():
        made = {f"{name}-{v}" for v in versions.split()}
        found |= made | ({f"{m}{end}" for m in made for end in ("-only", "-or-later", "+")} if name in GNU else set())
    return found


KNOWN = identifiers()


def notices() -> dict[str, str]:
    """Phrases of the method's own, with their labels: what licences are called, with and without their versions."""
    out = {
        "creative commons": "cc", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0",
        "public domain": "public-domain", "the unlicense": "unlicense", "proprietary and confidential": "proprietary",
    }
    for name, versions, title in FAMILIES.values():
        out[f"{title} license"] = name
        for v in versions.split():
            said = " ".join(v.replace("-", " ").replace(".", " ").split())
            short = said.removesuffix(" 0")
            if said[:1].isdigit() and "-" not in v:
                for form in {said, short}:
                    out |= {f"{title} license {form}": f"{name}-{v}", f"{title} license version {form}": f"{name}-{v}", f"{title} license v{form}": f"{name}-{v}"}
            else:
                out |= {f"{said} {title}": f"{name}-{v}", f"{title} {said}": f"{name}-{v}"}
    for name in SINGLE:
        out.setdefault(f"{' '.join(name.replace('.', '-').split('-'))} license", name)
    return out


NOTICES = {phrase: label for phrase, label in notices().items() if phrase not in BASE}
TAG = "spdx license identifier"

#: Grades by the start of a licence's name; the longest that fits counts.
GRADES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "cc": 0.6, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.1, "proprietary": 0.1,
}
UNKNOWN, EXCEPTION = 0.5, 0.1

#: To lower case, and everything in ASCII but letters and digits to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TAGS = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", re.I | re.A)
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*", re.I | re.A)
STRENGTH = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """A licence expression in reverse Polish order, or None if it isn't one. Operands and operators are lower-case."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what may come next
    for token in map(str.lower, TOKEN.findall(expression)):
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in STRENGTH:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                break  # the expression has ended; a comment follows
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def grade(name: str) -> float:
    fits = [k for k in GRADES if name == k or name.startswith(k + "-")]
    return GRADES[max(fits, key=len)] if fits else UNKNOWN


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Score and licences of a parsed expression. The right side of ``with`` is an exception, not a licence."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in STRENGTH:
            (right, names), (left, first) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, left + EXCEPTION), first))
            else:
                stack.append((max(left, right) if token == "or" else min(left, right), first | names))
        else:
            stack.append((grade(token), {token}))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None, find: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text in UTF-8."""
    words = (text or b"").translate(TABLE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = sorted((end + 1 - len(phrase) - 2, phrase) for end, phrase in find.iter(joined))
    places, labels, base, scores = [], set(), set(), []
    at = word = 0
    for start, phrase in hits:
        word += joined.count(" ", at, start)
        at = start
        if phrase in BASE:
            places.append(word)
            base.add(BASE[phrase])
        elif phrase == TAG:
            labels.add(TAG)
        else:
            labels.add(NOTICES[phrase])
    if TAG in labels:
        labels.discard(TAG)
        for expression in TAGS.findall(text.decode("utf-8", "replace")):
            rpn = parse(expression)
            if rpn is None:
                names = [t for t in map(str.lower, TOKEN.findall(expression)) if t not in STRENGTH and t not in "()"]
                rpn = names[:1] + [x for n in names[1:] for x in (n, "and")]
            if rpn:
                score, names = evaluate(rpn)
                scores.append(score)
                labels |= {n for n in names if n in KNOWN or n.startswith("licenseref-")}
    specific = {n for n in labels | base if not any(m != n and m.startswith(n + "-") for m in labels | base)}
    if not scores:
        scores = [grade(n) for n in specific]
    elif base:
        scores += [grade(n) for n in specific & base]
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        min(scores, default=0.0),
    )


def scan_licenses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key and what scan() finds in its text."""

    def make():
        find = automaton()
        return lambda texts: [scan(t, find) for t in texts]

    return map_texts(docs, make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", key)
