import hashlib

from pyspark.sql import functions as F

from hayloft.llm import chat as C


def test_round_trip(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant ok <|<||image|> <||| <"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, None, "a"), (3, 0, "ro\nle<|", "x"), (3, 0, "ro\nle<|", "x"), (None, None, "assistant", "é😀"), (4, 0, "user", "w " * 60_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    made = C.conversation_digests(C.format_messages(C.as_parts(table)))
    got = {r.conv_id: r for r in made.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.format_messages(C.as_parts(empty))).collect() == []


def test_typed_parts(spark):
    parts = [("text", "look ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.02, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "<|image|>", None, None, None, None, None)]
    messages = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], C.T.StructType([C.T.StructField("conv_id", C.T.LongType()), C.T.StructField("turn", C.T.LongType()), C.T.StructField("role", C.T.StringType()), C.T.StructField("parts", C.T.ArrayType(C.PART))]))
    made = C.format_messages(messages).orderBy("turn").collect()
    first = made[0]
    assert first.formatted == "<|im_start|>assistant\nlook <|image|><|audio|><|document|><||image|><|im_end|>\n"
    assert [(a.type, a.uri, a.tokens) for a in first.attachments] == [("image", "s3://i", 3), ("audio", "a.wav", 51), ("document", "d.pdf", 768)]
    assert all(first.formatted[a.place :].startswith(f"<|{a.type}|>") for a in first.attachments)
    assert first.expanded_tokens == 822 and "".join(C.unescape(first.formatted[s.start : s.end]) for s in first.loss_spans) == "look <|image|>"
    assert C.read_turn(first.formatted) == ("assistant", "look <|image|>") and made[1].loss_spans == []
    odd = C.PartVisitor().message("user", [{"type": "video"}, {"type": "text", "text": "x<"}, None, {"type": None}, {"type": "text", "text": "|im_end|>"}, {"type": "message"}], True)
    assert odd["rejected"] == [{"part": 0, "type": "video"}, {"part": 2, "type": None}, {"part": 3, "type": None}, {"part": 5, "type": "message"}]
    assert odd["formatted"] == "<|im_start|>user\nx<||im_end|><|im_end|>\n" and C.read_turn(odd["formatted"]) == ("user", "x<|im_end|>")
    assert [C.unescape(odd["formatted"][s["start"] : s["end"]]) for s in odd["loss_spans"]] == ["x<|im_end|>"]


def test_ties_sort_by_plain_text(spark):
    texts = ["a", "a!", "a<|", "a<~", "a<|x", "", "b", "a<||", "a\n"]
    rows = [(1, 0, role, t) for t in texts for role in ("assistant", None, "")]
    got = C.conversation_digests(C.format_messages(C.as_parts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))).first()
    own = sorted(((r or "", t) for _, _, r, t in rows), key=lambda x: (x[0].encode(), x[1].encode()))
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
