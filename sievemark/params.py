"""Fixed values of the similarity analysis."""

#: (tokens below, k) and (tokens below, window); the last value holds beyond.
K_STEPS, K_LAST = ((30, 3), (60, 4), (200, 5), (500, 7)), 9
WINDOW_STEPS, WINDOW_LAST = ((30, 2), (80, 3), (200, 4)), 5
#: Fewer than so many tokens: a k-gram needs two different ones, else three.
SHORT_TOKENS = 60
MIN_BLOCK_LINES = 3
#: (shorter length up to, least density) of strong blocks.
STRONG_STEPS, STRONG_LAST = ((8, 0.10), (15, 0.14)), 0.16
#: (shorter length up to, HIGH from, MEDIUM from).
CONFIDENCE_STEPS, CONFIDENCE_LAST = ((8, 0.38, 0.25), (20, 0.50, 0.28), (40, 0.60, 0.35)), (0.75, 0.55)
SMALL_BLOCK_LINES, SMALL_BLOCK_HASHES = 8, 3
MAX_STRONG_BLOCKS = 12
ASSIGNMENT_SLACK = 0.08
SEVERITY_HIGH, SEVERITY_MEDIUM = 0.7, 0.4
#: Priority of enclosing units.
UNIT_PRIORITY = {"LOOP": 1, "METHOD": 2, "IF": 3, "SWITCH": 4, "CLASS": 5}
#: Prose: lines of a unit that stands for a method.
PROSE_UNIT_LINES = 5
#: Time zone of terms and expiry, and days of warning and of grace.
ZONE, WARNING_DAYS, GRACE_DAYS = "America/Toronto", 15, 30
#: Report without strong blocks: least density and number of blocks; a lone block that flags a pair; files that are the same.
FALLBACK_DENSITY, FALLBACK_BLOCKS, LONE_DENSITY, SAME_FILE = 0.2, 8, 0.62, 0.90
#: Similarity from which the dashboard shows a pair.
DASHBOARD_SIMILARITY = 0.3
#: Source extensions of a submission by language, those of any source file, and those that the front end reads (case counts).
LANGUAGE_EXTENSIONS = {"c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp", ".hh", ".hxx"), "java": (".java",), "python": (".py",)}
SOURCE_EXTENSIONS = (".java", ".cpp", ".c", ".cc", ".h", ".hpp")
JAVA_EXTENSIONS, C_EXTENSIONS = (".java",), (".cpp", ".cc", ".c", ".h", ".hpp", ".cxx", ".hxx", ".C")
