"""Imports every query module so that the registry is complete."""

from riselens.plans import q_core  # noqa: F401
from riselens.plans import q_text  # noqa: F401
from riselens.plans import q_norm  # noqa: F401
from riselens.plans import q_eval  # noqa: F401
from riselens.plans import q_models  # noqa: F401
from riselens.plans import q_stream  # noqa: F401
from riselens.plans import q_textvec  # noqa: F401
from riselens.plans import q_ml  # noqa: F401
from riselens.plans import q_stats  # noqa: F401
from riselens.plans import q_io  # noqa: F401
from riselens.plans import q_checked  # noqa: F401
