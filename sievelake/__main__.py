import sys

from sievelake.cli import main

sys.exit(main())
