"""Imports every operator module so that their queries register."""

from vulnlake.operators import detect  # noqa: F401
from vulnlake.operators import profile  # noqa: F401
from vulnlake.operators import audit  # noqa: F401
from vulnlake.operators import history  # noqa: F401
from vulnlake.operators import textfeat  # noqa: F401
from vulnlake.operators import evaluation  # noqa: F401
from vulnlake.streaming import streams  # noqa: F401
from vulnlake.operators import training  # noqa: F401
from vulnlake.operators import columns  # noqa: F401
