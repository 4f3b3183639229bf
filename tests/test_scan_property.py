"""P7 property test: the JVM-side scan equals a plain Python model of the rule
(first pattern in list order that matches anywhere, case-insensitive, Python
whitespace; null or blank text is safe) on random texts built from pattern
words, Unicode whitespace and case-folding variants."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tokenledger import constants as K
from tokenledger.functions.injection import scan_text

_PY = [re.compile(p, re.IGNORECASE) for p in K.INJECTION_PATTERNS]


def model(t):
    if t is None or not t.strip():
        return None
    for rx, src in zip(_PY, K.INJECTION_PATTERNS):
        if rx.search(t):
            return src
    return None


WORDS = ["ignore", "all", "previous", "above", "prior", "instructions", "disregard", "your", "system", "prompt",
         "you", "are", "now", "pretend", "act", "as", "if", "[system]", "<|im_start|>", "human:", "assistant:",
         "###", ":", "x", "root", "ok"]
SEPS = [" ", "  ", "\t", "\n", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "", "-"]
VARIANTS = {"s": ["s", "S", "ſ"], "i": ["i", "I", "ı", "İ"], "k": ["k", "K", "K"]}


@st.composite
def texts(draw):
    parts = []
    for _ in range(draw(st.integers(0, 8))):
        w = draw(st.sampled_from(WORDS))
        case = draw(st.sampled_from(["lower", "upper", "title", "mixed"]))
        w = {"lower": w, "upper": w.upper(), "title": w.title(), "mixed": w}[case]
        if case == "mixed":
            w = "".join(draw(st.sampled_from(VARIANTS.get(c.lower(), [c.lower(), c.upper()]))) for c in w)
        parts.append(w)
        parts.append(draw(st.sampled_from(SEPS)))
    return draw(st.one_of(st.none(), st.just("".join(parts))))


@settings(max_examples=6, deadline=None)
@given(st.lists(texts(), min_size=60, max_size=60))
def test_scan_matches_python_model(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", scan_text("t").alias("p")).collect()}
    assert got == {i: model(t) for i, t in enumerate(batch)}


# ---------------------------------------------------------------- P11
def model_isolate(messages, override):
    """The merge rule in plain Python: blank override -> unchanged; else start
    from the stripped override, append each stripped non-empty system content
    not already contained, merged system message first, others in order."""
    if override is None or not override.strip():
        return messages
    merged, rest = override.strip(), []
    for role, content in messages:
        if role == "system":
            ex = (content or "").strip()
            if ex and ex not in merged:
                merged = merged + "\n\n" + ex
            continue
        rest.append((role, content))
    return [("system", merged)] + rest


PIECES = ["Be brief.", "be", "brief", "Stay safe.", "safe", "x", "", " ", "\n", "\xa0", " ", "\x1c"]


@st.composite
def contents(draw):
    if draw(st.integers(0, 9)) == 0:
        return None
    return "".join(draw(st.lists(st.sampled_from(PIECES), max_size=4)))


@st.composite
def conversations(draw):
    msgs = draw(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", None]), contents()),
                         max_size=6))
    return msgs, draw(contents())


@settings(max_examples=5, deadline=None)
@given(st.lists(conversations(), min_size=40, max_size=40))
def test_isolation_matches_python_model(spark, batch):
    from tokenledger.functions.messages import MESSAGES_TYPE, isolate_system_prompt
    rows = [(i, [(r, c, None) for r, c in m], o) for i, (m, o) in enumerate(batch)]
    df = spark.createDataFrame(rows, f"i int, m {MESSAGES_TYPE}, o string")
    got = {r["i"]: [(x["role"], x["content"]) for x in r["out"]]
           for r in df.select("i", isolate_system_prompt("m", "o").alias("out")).collect()}
    assert got == {i: model_isolate(m, o) for i, (m, o) in enumerate(batch)}
