"""Texts that operators trip over."""

ODD_TEXTS = [
    None, "", " ", "\n\n\t", "x", "one two", "one two three four five six", "one two three four five six",
    "The Fox said: it's we'll  I'D\n\n  end ", "naïve Ünïcödé ΑΣ İstanbul 日本語 ½ ３ 😀👩🏽‍🚀 é", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>",
    "12345 67 !!! ??? ...", "word " * 4000, "q" * 3000, "Released under the MIT License.\nsome other line of words here",
]
