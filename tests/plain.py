"""Plain readings of rules, to compare operators with on small inputs."""

import re


def plain_matches(rows, pattern, within_ms=None):
    """Matches among ``(time, id, letter)`` rows of one key, in time order.

    Every start is tried in turn; rows further apart than ``within_ms`` belong to
    different stretches.
    """
    far = lambda a, b: within_ms is not None and (b[0] - a[0]).total_seconds() * 1000 > within_ms
    stretches, out = [[]], []
    for row in rows:
        if stretches[-1] and far(stretches[-1][-1], row):
            stretches.append([])
        stretches[-1].append(row)
    for stretch in stretches:
        i = 0
        while i < len(stretch):
            m = re.match(pattern, "".join(x for _, _, x in stretch[i:]))
            if m and m.end() and not far(stretch[i], stretch[i + m.end() - 1]):
                out.append(stretch[i : i + m.end()])
                i += m.end()
            else:
                i += 1
    return out
