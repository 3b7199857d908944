"""The domain queries: importing this package registers all of them in skills.QUERIES."""

from gapweave.plans import learning, pages, skills, sources, texts, validation  # noqa: F401
