from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.functions import text as T

VECTORS = {
    "parseHTTPResponse": "parsehttpresponse parse http response", "parse_http_response": "parse_http_response parse http response", "foo foo_bar": "foo foo_bar foo bar", "Straße": "strasse", "STRASSE": "strasse",
    "foo.bar, next": "foo.bar foo bar next", "foo.": "foo foo.", "Foo::bar.": "foo::bar foo bar", "/src/HTTPServer.rs": "/src/httpserver.rs src httpserver http server rs", "foo-bar": "foo-bar foo bar", "HTTP2Server": "http2server", "": "", "... _": "",
}


@pytest.mark.parametrize("text", VECTORS)
def test_vectors(text):
    assert Counter(T.text_tokens(text)) == Counter(VECTORS[text].split())


def test_long_terms():
    (form,) = T.text_tokens("A" * 100_000)
    assert form.startswith(T.LONG_MARK) and len(form) < 100
    assert len(set(T.text_tokens("_".join(f"piece{i}" for i in range(5000))))) == 5001


def test_surfaces():
    assert T.text_surfaces("see Foo::bar. and x/y/ ...") == ["see", "foo::bar", "and", "x/y"]


def test_column_twin(spark):
    texts = [*VECTORS, "aBCd XMLHttpRequest2 éÉcole", "a.b.c- d::", None, "A" * 300, "a" * 300 + " " + "b" * 300 + ".", "WORD word. Word: WORD- 12 12. ǅ ǅ. ª ªb", "ﬁle ŉx ΐ ᏸ İstanbul ΣΊΣΥΦΟΣ ẞ ſ ς", "x" * 255 + "é."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {}
    for r in T.term_frequencies(rows, "id", "text").collect():
        found.setdefault(r.id, Counter())[r.term] = r.tf
    for i, text in enumerate(texts):
        assert found.get(i, Counter()) == Counter(T.text_tokens(text or "")), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1_.:/\\- é", max_size=30))
def test_tokens_of_parts(text):
    for form in T.text_tokens(text):
        assert form == T.fold_text(form)
