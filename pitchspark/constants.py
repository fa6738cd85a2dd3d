"""Fixed values shared by all operators."""

# The canonical pitch in metres, origin at the top-left corner.
PITCH_LENGTH_M = 105.0
PITCH_WIDTH_M = 68.0

# Names used in the ``dataset`` and ``agent_type`` columns.
METRICA = "metrica"
SKILLCORNER = "skillcorner"
SOCCERTRACK = "soccertrack"
STATSBOMB = "statsbomb"
SYNTHETIC = "synthetic"

PLAYER = "player"
BALL = "ball"
REFEREE = "referee"
UNKNOWN = "unknown"
AGENT_TYPES = (PLAYER, BALL, REFEREE, UNKNOWN)

# Speeds above these are reported as impossible (m/s).
PLAYER_SPEED_LIMIT_MPS = 12.0
BALL_SPEED_LIMIT_MPS = 40.0

# Keys of a moving agent's time series and of one snapshot of the pitch.
AGENT_KEYS = ["match_id", "period", "agent_id"]
FRAME_KEYS = ["match_id", "period", "frame_id"]
