import sys

from readloom.plans.session import main

sys.exit(main())
