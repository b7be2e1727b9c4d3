import sys

from quire.cli import main

sys.exit(main())
