from rankmill.llm import url_filter


def test_long_names_are_segmented_whole():
    model = url_filter.NameModel()
    for shift in range(0, 8):  # a word across the 200th letter, wherever it begins
        name = "a" * (192 + shift) + "casino" + "news" * 60
        assert model.words(name, "") == model.segmenter.split(name) == model.words("", "/" + name)
        assert "casino" in model.words(name, "")


def test_two_letters_of_a_path_are_a_word_unless_a_code():
    model = url_filter.NameModel()
    assert model.words("", "/ad/de/EN/x/7f/news") == ["ad", "news"]
    assert model.score(model.words("", "/ad/1")) != model.score(model.words("", "/de/1")) == model.score([])
