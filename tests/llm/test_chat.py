from tidemark.llm import chat

TURNS = "conv_id long, turn int, role string, text string, pair_id string"


def test_prefix_and_masks(spark):
    rows = [
        (0, 0, "user", "hi", "z"), (0, 1, "assistant", "yes", "z"), (0, 2, "user", "more", "z"),
        (1, 0, "user", "hi", "z"), (1, 1, "assistant", "no", "z"),
        (2, 0, "user", "a", "z"), (3, 0, "user", "a", "z"),
        (4, 0, "user", "alone", "z"),
        (6, None, None, None, "z"), (6, 0, "user", "x", "z"), (6, 0, "user", "x", "z"), (7, 0, "user", "x", "z"),
        (None, 0, "user", "nobody", "z"),
    ]
    got = {r.pair_id: r for r in chat.preference_pairs(chat.by_parity(spark.createDataFrame(rows, TURNS))).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    first = got[0]
    assert first.n_prompt_turns == 1
    assert first.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert first.chosen.startswith("<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user")
    assert first.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert first.rejected_mask == f"{len('<|im_start|>assistant ')}x0,{len('no<|im_end|> ')}x1"
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(int(run.split("x")[0]) for run in mask.split(",") if run) == len(text)
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert (got[2].n_prompt_turns, got[2].rejected) == (0, "")
    assert got[3].n_prompt_turns == 1 and got[3].chosen.count("<|im_start|>") == 2


def test_empty(spark):
    assert chat.preference_pairs(chat.by_parity(spark.createDataFrame([], TURNS))).collect() == []
