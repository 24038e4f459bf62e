"""Functions that tests lower, or expect to be refused."""

import json
import re
from functools import lru_cache

SPACES = re.compile(r"\s+")
ANCHORED = re.compile(r"^prefix")
DOLLAR = re.compile(r"[$]+")
NESTED = re.compile(r"[a[b]")
LOG = []
SET = frozenset("\t　​")
SCALE = 1.5


@lru_cache(maxsize=1)
def members():
    return frozenset("ab")


def affine(v):
    return v * SCALE + 1.25


def rounded(v):
    return round(v * 1.5 + 1.25, 6)


def branchy(v, limit=10.0):
    w = v - limit
    if w > 0.0:
        w = w * 2.0
        return w
    elif w == 0.0:
        return -1.0
    return v / 4.0


def nan_safe(v):
    return v == v


def none_or(v):
    return -1.0 if v is None else v + 1.0


def int_div(a, b):
    return a / b


def count_ints(xs, seed=3):
    for x in xs:
        if x >= 2:
            seed += 1
    return seed


def total(xs):
    return sum(x for x in xs)


def provider_join(t):
    return "".join(c if c not in members() else " " for c in t)


def mirrored_join(t):
    return "".join(" " if c in SET else c for c in t.strip())


def filtered_join(t):
    return "".join(c if c not in SET else " " for c in t if c)


def em_space(t):
    return SPACES.sub(" ", t).strip()


def dollars(t):
    return DOLLAR.sub("$1", t)


def anchored(t):
    return ANCHORED.sub("", t)


def nested_class(t):
    return NESTED.sub("", t)


def noisy(xs):
    n = 0
    for x in xs:
        LOG.append(x)
        n += 1
    return n


def two_sums(t):
    return sum(1 for c in t if c.isalpha()) - sum(1 for c in t if c.isdecimal())


def expanding(t):
    return t.translate(str.maketrans({"a": "bb", "c": ""}))


def overlapping(t):
    return t.translate(str.maketrans({"a": "ab", "b": "c"}))


def swapped(t):
    return t.translate(str.maketrans({"a": "b", "b": "a", "😀": "é"}))


def wrapped(t, **extra):
    return _base(t, **extra)


def _base(t, low=2, high=4):
    return low < len(t) < high


def lowered(t):
    return t.lower()


def needs_two(a, b):
    return a + b


def loop_if(t):
    hits = 0
    for c in t:
        if c.isdigit():
            hits += 1
    return hits / len(t) >= 0.5


SENTENCES = re.compile(r"(?<=[.!?])\s+")
GRADES = {"a": 1, "b": 2}
NAMES = {1: "one", 2: "two"}


def uppered(t):
    return t.upper()


def chunks(t):
    return " | ".join(p.strip() for p in SENTENCES.split(t) if p.strip())


def fields_joined(t):
    return "-".join(x for x in t.split(",") if x != "" and x != "b")


def rejoined(t):
    return "+".join(t.split("a"))


def counted(t):
    return t.count("aa") * 100 + t.find("a")


def trimmed(t):
    return t.removeprefix("pre").removesuffix("x")


def clamp(v):
    return max(0.0, min(v, 10.0))


def largest(a, b):
    return max(a, b, 3)


def grade_or(t):
    return GRADES.get(t, -1)


def name_or_none(n):
    return NAMES.get(n)


def labelled(t, n):
    return f"{t}={n}!"


def pair(v):
    return [v, v * 2]


def triple(t, n):
    return t, n, n > 1


def of_record(r):
    return r["ratio"] * 2.0 if r.flag else float(r["small"])


def letters_of(t):
    return sum(1 for c in t if c not in "abc")


def secret_code(t: str, salt: str = "") -> str:
    LOG.append(1)
    return "%s/%d" % (salt, len(t.encode()))


def sandwich(t):
    key = t.strip().replace("a", "b")
    code = secret_code(key, "s")
    return code + "!" + code.lower()


def in_a_branch(t):
    if len(t) > 2:
        return secret_code(t)
    return t


def untyped(t):
    return _untyped(t) + "x"


def _untyped(t):
    return "%s" % t


def wrong_type(t):
    return _wrong(t) + 1


def _wrong(t) -> int:
    return "%s" % t


CONFIG = '{"blank": "_", "scale": 3}'


@lru_cache(maxsize=None)
def cached_grade(t):
    return GRADES.get(t, 0) * 2


def with_constants(t):
    put = json.loads(CONFIG)["blank"]
    return re.sub("[0-9]+", put, re.compile("b+").sub("B", t))


def through_cache(t):
    return cached_grade(t.strip()) + json.loads(CONFIG)["scale"]
