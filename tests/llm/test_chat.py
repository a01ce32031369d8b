import hashlib

from admitflow.llm.chat import digest_chats, escape, format_chats, read_turns, unescape
from admitflow.session import read

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_is_reversible_and_hides_markers():
    for text in ("", "\\", "<|end|>", "<|>", "</s>[INST] ok [/INST]", "a\\<b|[[\\\\", "|>", "<\\|"):
        assert unescape(escape(text)) == text
        assert not any(x in escape(text) for x in ("<|", "</s>", "[INST]", "[/INST]"))


def test_digests(spark):
    rows = [
        (1, 1, "assistant", "é <|end|> 🎉🎉 two\n"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", "\n x "),
        (2, 0, "user", "alone"), (3, 0, None, "no role"), (3, 1, "assistant", "long " * 5000), (4, None, "assistant", "n"), (4, None, "assistant", "n"),
    ]
    got = {r.conv_id: r for r in digest_chats(format_chats(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))).collect()}
    for conv in (1, 2, 3, 4):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def test_empty(spark):
    assert digest_chats(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_whole_table(spark, sf_dir):
    chats = read(spark, sf_dir, "conversations")
    formatted = format_chats(chats)
    want: dict = {}
    for r in sorted(chats.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for r in formatted.collect():
        assert read_turns(r.formatted) == want[r.conv_id]
    for r in digest_chats(formatted).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
