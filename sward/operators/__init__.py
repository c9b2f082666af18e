"""Every operator under one name: ``from sward import operators as op``."""

from sward.operators import (  # noqa: F401
    coverage as coverage_ops,
    dominance,
    effects,
    events,
    grids,
    models,
    order,
    panel,
    richness,
    series,
    sets,
    summary,
)
from sward.operators.coverage import (  # noqa: F401
    coverage,
    coverage_filter,
    coverage_rows,
    fixed_locations,
    incidence_coverage,
    long_measures,
    sample_counts,
    sample_coverage,
    with_sample_counts,
)
from sward.operators.dominance import *  # noqa: F401,F403
from sward.operators.effects import *  # noqa: F401,F403
from sward.operators.events import (  # noqa: F401
    before_after_loss,
    biomass_by_loss,
    dominant_losses,
    first_losses,
    plot_flags,
)
from sward.operators.grids import even, grid, predict_grid, values  # noqa: F401
from sward.operators.models import *  # noqa: F401,F403
from sward.operators.order import *  # noqa: F401,F403
from sward.functions.semantics import safe_div  # noqa: F401
from sward.operators.panel import *  # noqa: F401,F403
from sward.operators.richness import *  # noqa: F401,F403
from sward.operators.series import *  # noqa: F401,F403
from sward.operators.sets import baseline_ranks, lagged_loss_set, lost_at_end_set, plot_year_bef  # noqa: F401
from sward.operators.summary import *  # noqa: F401,F403
from sward.operators.turnover import turnover  # noqa: F401
