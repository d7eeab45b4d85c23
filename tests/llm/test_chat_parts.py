"""Typed parts: control strings that are cut into several text parts, with attachments between."""

import random

import pytest

from gridloom.llm import chat_format as cf
from gridloom.llm import substring_dedup

CONTROL = [cf.TURN, cf.BODY, cf.END, "<|image:0|>", "<|audio:1|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "<\\\\|end|>"]


def part(kind, text=None, **more):
    return {"type": kind, "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more


def holds(parts):
    """Formatted and read back, a user's and an assistant's turn say what their text parts say."""
    told = "".join(p["text"] or "" for p in parts if p["type"] in (None, "text"))
    made = cf.render([{"role": "user", "parts": parts}, {"role": "assistant", "parts": parts}])
    assert cf.parse(made["formatted"]) == [("user", told), ("assistant", told)]
    (span,) = made["loss"]
    assert cf.said(made["formatted"][span["start"] : span["end"]]) == told
    assert len(made["attachments"]) == 2 * sum(p["type"] not in (None, "text") for p in parts)


@pytest.mark.parametrize("control", CONTROL)
def test_control_strings_cut_at_every_place(control):
    for i in range(len(control) + 1):
        for j in range(i, len(control) + 1):
            pieces = [control[:i], control[i:j], control[j:]]
            holds([part("text", p) for p in pieces])
            holds([part(None, pieces[0]), part("image", width=10, height=3), part("text", pieces[1]), part("text", None), part("text", pieces[2])])
            holds([part("text", pieces[0]), part("text", ""), part("text", pieces[1]), part("odd"), part("text", pieces[2])])


def test_random_parts():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice([*CONTROL, "<", "[", "\\", "|", ">", "a", "/"]) for _ in range(rng.randint(1, 6)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 5)))
        parts = [part("text", text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), part(rng.choice(["image", "audio", "document", "video"])))
        holds(parts)


def test_substring_dedup_refuses_other_ids(spark):
    df = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        substring_dedup.dedup(df)
