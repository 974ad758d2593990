"""Texts for the tests of the training-data operators."""

import random


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(words)] + ["Über", "ça", "naïve", "日本", "x,", "No."]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


#: texts that every operator must take: none, empty, blank, one word, special strings, odd spaces, very long, repeated
ODD = [None, "", " \n\t ", "One", "a b c d", "<|endoftext|> inside <|startoftext|> text", "tab\tand nbsp　wide  double \n\n lines ", "é́ combining Σας ς 'S it's",
       "word " * 3000, prose(1, 5000), prose(1, 5000), "same text twice over here", "same text twice over here", "Ends with line\n", "ÀÉ ÀÉ " * 40]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node long, h string, n string, id string, fp string, line string, words string, a string, host string"


def rows_of(pairs):
    return [(k, t, "en", "s", len(t or ""), 1, "h", "n", "i", "f", "l", "w", "a", "o") for k, t in pairs]
