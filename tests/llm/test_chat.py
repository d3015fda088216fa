import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import chat_format as C
from lexloom.llm.queries import MARKS

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, extra int"


def formatted(spark, rows):
    return {r["conv_id"]: r for r in C.format_chats(spark.createDataFrame([(*r, 1) for r in rows], EVENTS)).collect()}


def turns(row):
    return [(t["role"], t["text"]) for t in row["turns"]]


def test_fold(spark):
    out = formatted(spark, [
        (1, 5, "delta", 2, None, "lo"), (1, 1, "message", 1, "user", "Hi"), (1, 4, "delta", 2, None, "Hel"), (1, 3, "message", 2, "assistant", ""),
        (1, 6, "regenerate", 2, None, "x"), (1, 7, "delta", 2, None, "Good "), (1, 8, "delta", 2, None, "day"), (1, 9, "edit", 1, None, "Hey"), (1, 10, "unknown", 1, None, "?"),
        (2, 1, "message", 1, "user", None), (2, 1, "message", 1, "user", None), (None, 1, None, None, None, "q"),
    ])
    assert turns(out[1]) == [("user", "Hey"), ("assistant", "Good day")]
    assert turns(out[2]) == [("user", ""), ("user", "")]
    assert turns(out[None]) == [("", "q")]
    assert out[1]["formatted"] == "<|im_start|>user\nHey<|im_end|>\n<|im_start|>assistant\nGood day<|im_end|>\n"
    assert formatted(spark, []) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x", "\\n"]), st.text(st.sampled_from("<|>\\bpn\n a%é𝄞"), max_size=12) | st.just(MARKS)), min_size=1, max_size=6))
def test_round_trip(spark, rows):
    df = C.format_chats(spark.createDataFrame([(1, k, "message", k, role, text, 0) for k, (role, text) in enumerate(rows)], EVENTS))
    row, back, digest = df.first(), C.read_back(df).first(), C.digest(df).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == rows
    learnt = [t for r, t in rows if r == "assistant"]
    assert back["learnt"] == learnt
    assert row["formatted"].count("<|im_start|>") == len(rows) == row["formatted"].count("<|im_end|>")
    assert digest["loss_sha256"] == hashlib.sha256("".join(learnt).encode()).hexdigest() and digest["loss_chars"] == len("".join(learnt))
    assert digest["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
