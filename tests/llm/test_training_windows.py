"""Windows that the tagger learns from."""

from attesta.llm import pii


def test_late_windows_are_drawn():
    text = "in 1 of 2 " * 4000 + "mail ann@example.com or 1 of 2 " * 2000
    tags = [t for seed in range(20) for _, t in pii.training_windows(text, seed)]
    assert any(any(t) for t in tags)
