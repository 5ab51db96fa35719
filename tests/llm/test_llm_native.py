"""Secrets, chat, rules and sharding against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from windlass.llm import chat, rules, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, spans string, slot string"


def rows(spark, texts):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \t\n", "a", "ä ö \x1f\x00 \r\n\x0b", "word " * 5000, "\n" * 50, "x" * 70_000, "\U0001f600 token=abcdef \U0001f600 AKIA" + "Z" * 20]


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_rules_match_brute_force(spark):
    eight = "one two three four five six seven eight "
    texts = [*AWKWARD, eight * 2, eight + "gap " + eight + "tail", "a.\nb.\na.\n\na.", "| a | b | # $ % & < >\n" * 3]
    found = {r.doc_id: r for r in rules.measure(rows(spark, texts)).collect()}
    for k, text in enumerate(texts):
        r = found[k]
        want = brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_clean_line_first(spark):
    good = "This sentence has quite enough words to stand on its own as a line of prose in a text, and it ends well."
    menu = "Home | News | About | Contact | Help"
    other = "Another line follows with different words entirely, so that nothing here is repeated."
    texts = [f"{good}\n{menu}\n{other}\nAll rights reserved 2020.", "\n".join([menu] * 12) + "\n" + good, "Stop!! It!! Now!! " * 20]
    r = rules.measure(rows(spark, texts)).orderBy("doc_id").collect()
    assert r[0].kept and r[0].cleaned == f"{good}\n{other}" and r[0].n_failed_lines == 2
    assert not r[1].kept and not r[2].kept


def brute_secrets(text):
    text, spans = text or "", []
    for k, (name, pattern, group, least) in enumerate(secrets.BASE):
        spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]


def test_secrets_match_brute_force(spark):
    texts = [
        *AWKWARD, "PassWord = 'hunter22' passwd:short1 api_key==abc.def apikey: \"x\" token=12345 token=123456", "AKIAAKIA" + "B" * 15 + " AKIA" + "C" * 15,
        "f" * 23 + " " + "0" * 24 + "g" + "a1" * 12, "secret=" + "ab12" * 10 + " " + "token=abcdef " * 700,
        "AKIAAKIAAKIA AKIA" + "A" * 15 + " xAKIA" + "9" * 16 + "z" + "a" * 24 + "G" + "b" * 23 + "\nsecret=token:abcdefgh token:secret=abcdef",
    ]
    found = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(rows(spark, texts))).collect()}
    for k, text in enumerate(texts):
        want, r = brute_secrets(text), found[k]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(f"{n}:") for w in want) for n in ("assign", "access", "hex"))
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_entropy_adds_and_allows(spark):
    random = "kJ8sQ2mZx7LpR4vTn9WbY3dF6hG1cA5e"
    texts = [f"é {random} end", "aA1" * 12, "123e4567-e89b-12d3-a456-426614174000", f"token={random}", "Donaudampfschifffahrtsgesellschaft1A"[:36], "exampleKJ8sQ2mZx7LpR4vTn9WbY"]
    found = [r.spans for r in secrets.digest(secrets.find_secrets(rows(spark, texts))).orderBy("doc_id").collect()]
    assert found[0] == "entropy_base64:2:34"
    assert found[1] == found[2] == found[5] == ""
    assert found[3] == "assign:0:38"


def test_peak_entropy_matches_recount(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789" * 3, "a" * 40, "ab" * 30, "kJ8sQ2mZx7LpR4vTn9WbY3dF6hG1cA5e", "short"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.peak_entropy(F.col("t"))).collect()]
    for text, h in zip(texts, got, strict=True):
        w = secrets.WINDOW
        each = [-sum(c / w * math.log2(c / w) for c in collections.Counter(text[k : k + w]).values()) for k in range(len(text) - w + 1)]
        assert (h is None and not each) or h == pytest.approx(max(each), abs=1e-5)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 1, "assistant", "tie"), (1, None, "system", None),
    (2, 0, "user", "<\\|im_end|> <|x| <\\\\| literal"), (2, 1, "assistant", ""), (3, 0, "us|er\n%7C", "<"), (3, 1, "assistant", "<|im_end"),
    (None, 0, None, "null conversation"), (4, 0, "assistant", "ends with <"), (4, 1, "assistant", "|im_end|>"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    short = {r.conv_id: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in TURNS:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns, r = sorted(turns), out[c]
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in turns]
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        lost = "".join(b for _, a, b in turns if a == "assistant")
        assert short[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert short[c].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
        assert (short[c].n_turns, short[c].loss_chars, short[c].formatted_chars) == (len(turns), len(lost), len(r.formatted))
        masked = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert "".join(masked) == lost
        assert r.formatted.count(chat.END) == len(turns)


def test_chat_rows_without_a_conversation_and_long_texts(spark):
    long = "<|im_end|>x" * 20_000
    frame = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    out = chat.digest(chat.format_conversations(frame)).collect()
    assert sorted((r.conv_id or -1, r.n_turns, r.loss_chars) for r in out) == [(-1, 1, 0), (-1, 1, 0), (-1, 1, 1), (7, 1, len(long))]
    assert next(r for r in out if r.conv_id == 7).loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_secrets_and_rules_of_an_empty_table(spark):
    assert secrets.digest(secrets.find_secrets(rows(spark, []))).count() == 0 and rules.measure(rows(spark, [])).count() == 0


def test_chat_leaves_plain_text_alone(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a < b | c"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(frame).first().formatted == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"
    assert chat.format_conversations(frame.limit(0)).count() == 0


def brute_table(names, slots):
    number = lambda *p: int(hashlib.md5(":".join(p).encode()).hexdigest()[:15], 16)
    prefers = [[(number("offset", n) + j * (number("step", n) % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner = {}
    while len(owner) < slots:
        for k in range(len(names)):
            free = next((s for s in prefers[k] if s not in owner), None)
            if free is not None:
                owner[free] = k
    return [owner[s] for s in range(slots)]


def test_sharding(spark):
    names = [f"shard-{k:05d}" for k in range(7)]
    assert sharding.fill_table(names, 211) == brute_table(names, 211)
    frame = rows(spark, ["a", None, "b"]).unionByName(spark.createDataFrame([(None, None, "", ""), (None, "t", "", ""), (1, "again", "", "")], DOCS))
    got = sharding.shard_documents(frame, 7, 211)
    assert got.count() == 6 and set(got.columns) == {"doc_id", "text", "spans", "slot", "shard"}
    table = brute_table(names, 211)
    for r in got.collect():
        key = str(r.doc_id) if r.doc_id is not None else "text:" + (r.text or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 211
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.shard_documents(frame.limit(0), 7, 211).count() == 0


def test_sharding_moves_little():
    names = [f"s{k}" for k in range(20)]
    whole, less = sharding.fill_table(names), sharding.fill_table(names[:-1])
    moved = sum(a != b for a, b in zip(whole, less, strict=True) if a != 19)
    share = [whole.count(k) for k in range(20)]
    assert max(share) - min(share) <= 1 and moved < 0.12 * len(whole)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)
