import sys

from pitchspark.cli import main

sys.exit(main())
