"""Features of the classifiers."""

from codonflow.llm import quality, toxicity


def test_words_share_a_four_letter_stem():
    assert toxicity.BITS == 20
    shared = lambda a, b: len(set(toxicity.grams(a)) & set(toxicity.grams(b)))
    assert shared("snarfing", "snarled") == 2  # sna~ and snar~
    assert shared("snarfing", "snail") == 1


def test_letters_are_sought_in_whole_words():
    at = quality.FEATURES.index("letterless_words")
    assert quality.features("12345678abc --------word 123456789 word")[at] == 0.25
