"""Shared runs of characters from a table of all windows."""


def shared(docs, length):
    """docs: (doc_id, text). -> sorted (doc_id, from, to)."""
    owner = {}
    several = set()
    for doc, text in docs:
        for i in range(len(text or "") - length + 1):
            w = hash(text[i:i + length])
            if owner.setdefault(w, doc) != doc:
                several.add(w)
    marks = {}
    for doc, text in docs:
        for i in range(len(text or "") - length + 1):
            if hash(text[i:i + length]) in several:
                marks.setdefault(doc, set()).update(range(i, i + length))
    out = []
    for doc, covered in marks.items():
        start = before = None
        for c in sorted(covered):
            if before is None or c != before + 1:
                if before is not None:
                    out.append((doc, start, before + 1))
                start = c
            before = c
        out.append((doc, start, before + 1))
    return sorted(out)
