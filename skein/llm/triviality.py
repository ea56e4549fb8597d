"""Descriptions that say nothing: blank, marks or tags, fillers, promises, pointers elsewhere, or the name again."""

from __future__ import annotations

import re
from collections import Counter

# fixed values: words that carry no description by themselves in a comment on a function
_FILLERS = frozenset("""a an the this that these those it its it's is are be was of to for in on at by as with from and or which one all any some has have had
used use uses using does do did doing job function functions method methods routine procedure func fn def class module file package here
self cls args arguments parameters parameter params param returns return returned raises yields result results value values none null void n na x
der die das diese dieser funktion methode ist eine und el la los función método es une fonction méthode cette est le les""".split())
# fixed values: words about documentation itself, about work to do on it, or that point elsewhere for it
_ANCHORS = frozenset("""doc docs document documents documentation documented documenting undocumented docstring docstrings comment comments describe describes description
descriptions described summary details explanation todo fixme xxx tbd wip hack placeholder stub see seen refer reference
inherit inherits inherited inheritdoc override overrides lorem ipsum soon""".split())
# fixed values: words that go with those, and mean something of their own without them
_WITH_ANCHORS = frozenset("""text texts short long longer brief line lines first then another more something stuff things thing etc auto inserted insert generated replace
fill filled filling add added adding write written writing put missing pending later next release releases future version versions once interface settled stable
will shall should must what how come coming go goes going still someone somebody please not yet no dolor sit amet look above below parent base super superclass ancestor
same name elsewhere there upstream information info""".split())

_TAG = re.compile(r"\{?@\w+\}?|:(?:param|type|arg|raises?|rtype|returns?)\b[^:\n]*:?|<[^>\n]*>")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", text))]


def _stem(word: str) -> str:
    for end in ("ings", "ing", "ies", "es", "ed", "s", "e", "y"):
        if len(word) - len(end) >= 3 and word.endswith(end):
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def informative(documentation: str | None, name: str | None) -> bool:
    """Whether a description of the function ``name`` says something beyond the name.

    Null and blank descriptions don't; nor do those whose words are all tags,
    fillers, forms of the name's words or words about documentation (with
    these, also words that go with them), nor one word over and over.
    """
    if not documentation or not documentation.strip():
        return False
    own = {_stem(w) for w in _words(name or "")}
    said = [w for w in _words(_TAG.sub(" ", documentation)) if w not in _FILLERS and _stem(w) not in own]
    rest = [w for w in said if w not in _ANCHORS]
    if not rest or len(rest) < len(said) and all(w in _WITH_ANCHORS for w in rest):
        return False
    return not (len(said) >= 4 and 2 * Counter(said).most_common(1)[0][1] >= len(said) and all(w in _WITH_ANCHORS for w in said))
