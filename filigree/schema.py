"""Column layouts shared by all operators (DDL)."""

NODES = "graph_id string, node_id long, x double, y double"
EDGES = "graph_id string, u long, v long, weight double"
HOPS = "graph_id string, src long, dst long, d double"
BALLS = "graph_id string, src long, r double, cnt long"
CANDIDATE = "candidate_id long, attempt int, nodes array<struct<node_id:long,x:double,y:double>>, edges array<struct<u:long,v:long>>"

#: Column aliases accepted in edge lists and positions, in order of preference (fixed values).
SOURCE_ALIASES = ("source", "source_index", "from", "u")
TARGET_ALIASES = ("target", "target_index", "to", "v")
WEIGHT_ALIASES = ("weight", "edge_weight")
X_ALIASES = ("x", "pos_x")
Y_ALIASES = ("y", "pos_y")
