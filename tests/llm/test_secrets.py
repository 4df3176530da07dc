from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.op6_secrets import op6_secrets
from tessera.llm.secrets import KINDS, _parts_from, find_secrets, guess_cost, mask_secrets, ranks, redact, scan, whole_cost

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(6)
    bits = ["password", "PassWd", "ſecret", "Api_Key", "apikey", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "x", "é", "\n", "-", "/"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in scan(text, PATH) if s[1] < 3] == base(text), text


def test_cost_prefers_cheap_segmentations():
    cost = lambda v: guess_cost(v, PATH)
    assert cost("password") < 6 and cost("qwertyuiop") < 6 and cost("aaaaaaaaaa") < 4 and cost("abcabcabc") < 5 and cost("01/02/1990") < 7
    assert cost("x9$Kq2!vLw8z") > 10 and cost("password1") < cost("pqzxword1") and cost("P@ssword") < 8 and cost("") == 0.0
    assert cost("correcthorsebattery") < 19


def test_the_method_adds_context_values():
    text = "login: x9$Kq2!vLw8z and pwd is password, passphrase = qwertyuiop"
    spans = scan(text, PATH)
    assert [(KINDS[k], text[a:b]) for a, k, b in spans] == [("guess", "x9$Kq2!vLw8z")]


def test_values_are_priced_whole():
    """A cheap start hides no secret, and the end that stops early decides as the whole cost does."""
    rng = random.Random(9)
    rest = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(32))
    text = "pwd=" + "z" * 40 + rest
    assert scan(text, PATH) == [(4, 3, len(text))] and redact(text, scan(text, PATH)) == "pwd=[SECRET]"
    assert scan("pwd=" + "z" * 5000, PATH) == [] and scan("pwd=" + "z" * 2000 + rest, PATH) == [(4, 3, 2036)]
    bits = ["password", "qwerty", "000", "1990", "x", "Kq", "7", "abcabc", "horse"]
    for _ in range(300):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        assert (guess_cost(value, PATH, 10.0) >= 10) == (guess_cost(value, PATH) >= 10), value


def every(value):
    """The least whole cost over all segmentations, each of which is written out."""
    n, least = len(value), float("inf")
    parts = [list(_parts_from(value, i, ranks(PATH), PATH, float("inf"))) for i in range(n)]
    todo = [(0, 0, 0.0)]
    while todo:
        at, k, cost = todo.pop()
        if at == n:
            least = min(least, whole_cost(k, cost))
        else:
            todo += [(j, k + 1, cost + c) for j, c in parts[at]]
    return least


def test_costs_against_every_segmentation():
    rng = random.Random(2)
    for _ in range(250):
        value = "".join(rng.choice(["ab", "a", "cat", "qwe", "1990", "7", "K", "0", "dog"]) for _ in range(rng.randint(1, 5)))[:11]
        assert abs(guess_cost(value, PATH) - every(value)) < 1e-9, value
    many = "".join(rng.choice(["cat", "dog", "sun", "tree"]) + str(rng.randrange(10)) for _ in range(12))  # more parts than eight
    assert guess_cost(many, PATH) < len(many) + 1 and guess_cost("recentlychampionshipchampionshipchampionship", PATH) < 8


def test_query(spark, sample):
    got = {r.doc_id: r for r in op6_secrets(spark, sample).collect()}
    rows = table(spark, sample, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base(r.text or "")]
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(own.spans.split(",") if own.spans else [])
        assert [own.n_assign, own.n_access, own.n_hex] == [sum(s.startswith(k + ":") for s in spans) for k in KINDS[:3]]


def test_edges(documents):
    df = documents([(1, "token = 'abcdefgh12345' \U0001f600 secret:aaaabbbbcccc"), (2, "deadbeef" * 4)])
    got = {r.doc_id: r for r in df.select("doc_id", find_secrets(F.col("text"), PATH).alias("s")).select("doc_id", "s.*").collect()}
    assert got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and got[900].spans == "" and got[1].n_assign == 2 and got[2].n_hex == 1
    assert got[1].base_sha256 == hashlib.sha256(b"assign:0:22,assign:26:45").hexdigest()
    masked = {r.doc_id: r.text for r in df.select("doc_id", mask_secrets(F.col("text"), PATH).alias("text")).collect()}
    assert masked[1] == "[SECRET]' \U0001f600 [SECRET]" and masked[900] is None and masked[901] == "" and masked[2] == "[SECRET]"
    assert redact("abcdef", [(0, 0, 3), (2, 1, 4)]) == "[SECRET]ef" and documents(edges=False).select(find_secrets(F.col("text"), PATH)).count() == 0
