"""Plain versions of engine kernels, for small inputs."""

import math

import numpy as np


def cost_field(dsm: np.ndarray, chm: np.ndarray, cell: float, rules, z: float = math.nan, height: float = math.nan) -> np.ndarray:
    """Path costs from the window's centre, breadth first; infinite where a crown does not reach.

    A step costs its length, uphill its length in space, and above the treetop the penalty for the
    rise. Cells below the crown's base or the least height are not entered; a cell is left only while its
    cost is below its own height (scaled) and the limit. Each cell is priced once, from the three
    cells on the side it is entered from. The top is the centre or, where that is higher or the centre's cell has no
    data, the treetop's own ``z`` and ``height``: the centre of a patch need not be one of its cells.
    """
    size = dsm.shape[0]
    mid = size // 2
    top = np.fmax(dsm[mid, mid], z)
    floor = top - rules.crown_ratio * np.fmax(chm[mid, mid], height)
    if math.isnan(dsm[mid, mid]):
        dsm, chm = dsm.copy(), chm.copy()
        dsm[mid, mid], chm[mid, mid] = top, np.fmax(chm[mid, mid], height)
    cost = np.full(dsm.shape, math.inf)
    seen = np.zeros(dsm.shape, bool)
    cost[mid, mid], seen[mid, mid] = 0.0, True
    queue = [(mid, mid)]
    for y, x in queue:
        for dy, dx in ((-1, 0), (1, 0), (0, 1), (0, -1), (-1, -1), (-1, 1), (1, 1), (1, -1)):
            v, u = y + dy, x + dx
            if not (0 <= v < size and 0 <= u < size) or seen[v, u]:
                continue
            seen[v, u] = True
            z = dsm[v, u]
            if math.isnan(z) or math.isnan(chm[v, u]) or chm[v, u] < rules.minimum_height or z < floor:
                continue
            if dx and dy:
                before = ((v - dy, u), (v - dy, u - dx), (v, u - dx))
            elif dx:
                before = tuple((v + k, u - dx) for k in (-1, 0, 1))
            else:
                before = tuple((v - dy, u + k) for k in (-1, 0, 1))
            best = math.inf
            for b, a in before:
                if not (0 <= b < size and 0 <= a < size) or math.isinf(cost[b, a]):
                    continue
                run = cell * (math.sqrt(2) if b != v and a != u else 1.0)
                rise = z - dsm[b, a]
                step = math.hypot(run, rise) if rise > 0 else run
                best = min(best, cost[b, a] + step + (rules.above_top_penalty * rise if z > top else 0.0))
            cost[v, u] = best
            if best < rules.cost_scale * chm[v, u] and best < rules.cost_limit:
                queue.append((v, u))
    return cost
