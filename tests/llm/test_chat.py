import hashlib

from sitecast.llm import chat

ROWS = "conv_id long, turn long, role string, text string, example string"


def digests(spark, rows):
    examples = chat.expand_replies(spark.createDataFrame(rows, ROWS))
    return examples, {r["conv_id"]: r for r in chat.conversation_digests(examples).collect()}


def test_every_reply_is_an_example_with_its_whole_prefix(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "assistant", "b", ""), (1, 2, "user", "c", ""), (1, 3, "assistant", "d", "")]
    examples, _ = digests(spark, rows)
    got = sorted((r["example"], r["formatted"], r["formatted"][r["target_start"] : r["target_end"]]) for r in examples.collect())
    first = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got == [
        (0, first, "b"),
        (1, first + "<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n", "d"),
    ]


def test_control_strings_backslashes_and_empty_values_come_back(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|\\\\b<\\p|\\n", "", None, "\n\n", "<", "é<|"]
    rows = [(i, t, role, x, "") for i, x in enumerate(hard) for t, role in ((0, "user"), (1, "assistant"))]
    rows += [(99, 0, "us\ner\\", "x", ""), (None, 0, "assistant", "y", ""), (98, 0, None, "z", "")]
    _, got = digests(spark, rows)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    for i, x in enumerate(hard):
        x = x or ""
        assert got[i]["turns_sha256"] == sha(f"user\n{x}\nassistant\n{x}\n")
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(x), sha(x))
    assert got[99]["turns_sha256"] == sha("us\ner\\\nx\n")
    assert got[99]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == sha("y")
    assert got[98]["turns_sha256"] == sha("\nz\n")


def test_trailing_turns_ties_and_repeats_are_kept(spark):
    rows = [(1, 1, "user", "b", ""), (1, 1, "user", "a", ""), (1, 0, "assistant", "r", ""), (1, 1, "user", "a", ""), (1, None, "system", "s", "")]
    _, got = digests(spark, rows)
    text = "system\ns\nassistant\nr\nuser\na\nuser\na\nuser\nb\n"
    assert got[1]["n_turns"] == 5
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert digests(spark, [])[1] == {}
