"""What an encoder of token files keeps."""

from sparrowgrid.llm import tokenfile


def test_encoder_keeps_a_word_once():
    e = tokenfile.Encoder(tokenfile.vocabulary())
    text = "one one, one. one! one (one"
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(memoryview(e.encode(text)).cast("H")) == want
    tables = [t for t in vars(e).values() if isinstance(t, tokenfile.Table)]
    assert sum(map(len, tables)) == 6  # "one", " one", ",", ".", "!", " ("
