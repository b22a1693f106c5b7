"""Fixed values shared by the operators."""

TITLE = "title"
SECTION_TITLE = "section.title"
SECTION_DESCRIPTION = "section.description"
QUESTION = "question.text"
ANSWER = "answer.text"

# The five labels, in report order.
LABELS = [TITLE, SECTION_TITLE, SECTION_DESCRIPTION, QUESTION, ANSWER]

MISSED = "__missed__"
NO_GOLD = "__no_gold__"

# Fixed value: share of a predicted item's tokens that must lie in the gold item.
CONTAINMENT_THRESHOLD = 0.75

# Fixed value: score differences below this are noise.
NOISE_FLOOR = 0.005
