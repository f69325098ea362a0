"""Texts that every operator over documents must cope with."""

#: Nulls, empties, short and long texts, repeats, ties, odd characters.
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "word " * 4000), (5, "x" * 30_000), (None, "no id here at all"),
       (None, None), (7, "Same text twice in the table, with quite a few words to compare and to remove."),
       (7, "Same text twice in the table, with quite a few words to compare and to remove."),
       (8, "Same text twice in the table, with quite a few words to compare and to remove."),
       (9, "İstanbul ΑΣ Straße \u0000   ퟿ 日本語テキスト 🙂🙂 <|endoftext|> don't WE'LL 12345 ---"),
       (10, "é" * 60), (11, "é" * 60 + "é"), (12, "the the the the the the the the the the the the the the the the the")]
