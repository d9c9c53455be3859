"""Small hand-written maps."""


def osm(nodes, ways, head="<osm version='0.6' generator='hand'>"):
    out = ["<?xml version='1.0' encoding='UTF-8'?>", head]
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        else:
            i, lat, lon, *tags = n
            out.append(f"<node id='{i}' action='modify' visible='true' lat='{lat}' lon='{lon}'>" + "".join(f"<tag k='{k}' v='{v}'/>" for k, v in tags) + "</node>")
    for i, nds, tags in ways:
        out.append(f"<way id='{i}' action='modify' visible='true'>" + "".join(f"<nd ref='{r}'/>" for r in nds) + "".join(f"<tag k='{k}' v='{v}'/>" for k, v in tags.items()) + "</way>")
    return "\n".join([*out, "</osm>"]).encode()


def area(name, kind="room", level="1", **more):
    return {"name": name, "osmAG:type": "area", "osmAG:areaType": kind, "level": level, "indoor": "room"} | {k.replace("_", ":"): v for k, v in more.items()}


def passage(start, end, level="1", name=None):
    return {"name": name or f"{start}_to_{end}", "osmAG:type": "passage", "osmAG:from": start, "osmAG:to": end, "level": level}


GRID = [(-1, 31.0, 121.0), (-2, 31.0, 121.0001), (-3, 31.0001, 121.0001), (-4, 31.0001, 121.0), (-5, 31.0, 121.0002), (-6, 31.0001, 121.0002)]
RING_A, RING_B = [-1, -2, -3, -4, -1], [-2, -5, -6, -3, -2]

OK = osm(GRID, [(-10, RING_A, area("E1a-F1-01")), (-11, RING_B, area("E1a-F1-02")), (-12, [-2, -3], passage("E1a-F1-01", "E1a-F1-02"))])
BAD = osm(
    [*GRID, (-7, 91, -181), "<node id='-8' lat='abc' lon='1'/>", "<node id='-9' lon='1'/>", "<node id='-20' lat='1' lon='1' action='foo'/>"],
    [
        (-10, [-1, -2, -99, -4], {"osmAG:type": "area", "osmAG:areaType": "lobby", "level": "x"}),
        (-11, [-1, -2], area("Small", level="99")),
        (-12, [-2], {"osmAG:type": "passage", "name": "p"}),
        (-13, [-2, -3], passage("Nowhere", "Small", level="99")),
        (-14, RING_A, area("Child", level="2", **{"osmAG_parent": "Small"})),
        (-15, RING_A, {"osmAG:type": "thing"}),
        (-16, RING_A, area("E1-P1", "elevator")),
        (-17, RING_A, area("E1-ST-01", "stairs")),
        (-18, RING_A, area("E1-ST-01", "stairs")),
        (-19, [-2, -3], passage("E1-P1", "E1-P1", level="")),
        (-21, [-2, -3], passage("E1-ST-01", "E1-ST-01", level="1")),
        (-22, [-2, -3], passage("Small", "Small", level="y")),
    ],
)
