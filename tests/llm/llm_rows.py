"""Row helper shared by the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))
