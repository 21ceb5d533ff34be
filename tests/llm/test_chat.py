import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthlake.llm import chat

TEXTS = st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "\\", "<\\/s>", "<|image:0|>", "<TURN user>", "</TURN>", "a", " ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(["user", "assistant", "system", "a>b", "", "</s>"]))
def test_turns_read_back_as_they_were(text, role):
    segment, start, end, _ = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.read_turn(segment) == (role, text)
    assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")
    body = chat.escape(text)
    assert not any(mark in body for mark in ("[INST]", "[/INST]", "<s>", "</s>", "<|image:", "</TURN>"))


def test_visitor_flattens_typed_parts():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "uri": "a.png", "width": 28, "height": 15}, {"type": "audio", "uri": "b.wav", "seconds": 1.01}, {"type": "document", "uri": "c.pdf", "pages": 2}]
    segment, _, _, seen = chat.format_turn("user", parts)
    assert segment == "[INST] see <|image:0|><|audio:1|><|document:2|> [/INST]"
    assert seen.attachments == ["a.png", "b.wav", "c.pdf"] and seen.tokens == 2 * 2 + 26 + 1024


def test_conversations_with_nulls_ties_and_clashes(spark):
    turns = [(1, 1, "assistant", "b </s>"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "x"), (None, 0, "user", "n"), (None, None, "assistant", ""), (2, 5, "assistant", "y" * 50_000)]
    frame = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, n long")
    content = frame.withColumn("content", chat.parts_of_text("text"))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(content)).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for key in (1, 2, None):
        own = sorted((t for t in turns if t[0] == key), key=order)
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        got = found[key]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    none = content.where(F.lit(False))
    assert chat.read_back(chat.format_turns(none)).count() == 0


PART = st.one_of(
    st.sampled_from(["a <", "/s>[INST", "] x", "<", "|image:0|>", "[", "INST]", "\\", "é", "", None]).map(lambda t: {"type": "text", "text": t}),
    st.sampled_from(["image", "audio", "document"]).map(lambda k: {"type": k, "uri": f"x.{k}", "width": 28, "height": 28, "seconds": 1.0, "pages": 1}),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=10), st.sampled_from(["user", "assistant", "system"]))
def test_parts_read_back_as_they_were(parts, role):
    segment, _, _, seen = chat.format_turn(role, parts)
    _, body = chat.read_turn(segment)
    raw = segment[segment.index(">") + 1 : segment.rindex("<")] if role != "user" else segment[7:-8]
    want = []
    for p in parts:
        text = p["text"] or "" if p["type"] == "text" else None
        if text is None:
            want.append((p["type"], p["uri"]))
        elif want and want[-1][0] == "text":
            want[-1] = ("text", want[-1][1] + text)
        elif text:
            want.append(("text", text))
    assert chat.read_parts(raw, seen.attachments) == want
    assert len(chat.PLACEHOLDER.findall(segment)) == len(seen.attachments) == sum(p["type"] != "text" for p in parts)
    assert not any(mark in raw for mark in ("[INST]", "[/INST]", "<s>", "</s>"))


def test_odd_parts_have_a_defined_result():
    nan, inf = float("nan"), float("inf")
    parts = [None, {"type": "video", "uri": "v", "pages": 1}, {"type": "audio", "uri": None, "seconds": nan}, {"type": "audio", "uri": "b", "seconds": inf}, {"type": "image", "uri": "i", "width": -5, "height": None}, {"type": None, "text": None}]
    segment, _, _, seen = chat.format_turn("user", parts)
    assert segment == "[INST] <|document:0|><|audio:1|><|audio:2|><|image:3|> [/INST]"
    assert seen.attachments == ["v", "", "b", "i"] and seen.tokens == 512


def test_attachments_of_whole_conversations(spark):
    image, text = {"type": "image", "uri": "a.png", "width": 28, "height": 14}, {"type": "text", "text": "<|image:9|> see "}
    audio = {"type": "audio", "uri": "b.wav", "seconds": 2.0}
    turns = [(1, 0, "user", [text, image, None]), (1, 1, "assistant", [audio, text]), (2, 0, "user", None)]
    content = spark.createDataFrame(turns, f"conv_id long, turn long, role string, content {chat.PARTS}")
    formatted = chat.format_turns(content)
    rows = {(r["conv_id"], r["n"]): r for r in formatted.collect()}
    assert rows[1, 0]["attachments"] == ["a.png"] and rows[1, 0]["attachment_tokens"] == 2 and rows[1, 1]["attachment_tokens"] == 50
    assert {r["conv_id"]: (r["n_turns"], r["n_attachments"]) for r in chat.read_back(chat.format_turns(content)).collect()} == {1: (2, 2), 2: (1, 0)}
